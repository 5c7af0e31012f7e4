"""Text and markup expressions (E01-E21): Column in, Column out, all in the JVM.

Quirks that are kept on purpose: an attribute name is not anchored, so `src` can match inside `data-src`; either kind of
quote ends a quoted value; `&amp;` is decoded before `&lt;`; the word count covers the title and the navigation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as web scripts mean it; \s leaves out the no-break space and a few others.
SPACE = r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The entities that are decoded, in order.
ENTITIES = [("nbsp", " "), ("amp", "&"), ("quot", '"'), ("#39", "'"), ("lt", "<"), ("gt", ">")]
#: The further entities of the second decoder.
MORE_ENTITIES = [("apos", "'"), ("#x27", "'"), ("#x2F", "/")]
EXCERPT, KEYWORD_EXCERPT = 12_000, 7_000
#: The characters of SPACE.
BLANKS = " \t\n\v\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Without the blanks of SPACE at both ends; only the ends are looked at, where a pattern would try every character."""
    return F.trim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def decode(c: Column) -> Column:
    for name, said in ENTITIES:
        c = F.regexp_replace(c, f"(?i)&{name};", said)
    return c


def decode_more(c: Column) -> Column:
    """The second decoder, with decimal entities.  Text is cut at the entities, and each piece is decoded by itself."""
    for name, said in [*ENTITIES, *MORE_ENTITIES]:
        c = F.regexp_replace(c, f"(?i)&{name};", said)
    plain = F.split(c, r"&#\d{1,7};", -1)
    codes = F.regexp_extract_all(c, F.lit(r"&#(\d{1,7});"), 1)

    def char(code: Column) -> Column:
        n = code.cast("int")
        surrogate = n.between(0xD800, 0xDFFF)
        one = lambda b: F.decode(F.unhex(b), "UTF-8")
        byte = lambda x: F.lpad(F.hex(x), 2, "0")
        tail = lambda shift: byte(F.shiftright(n, shift).bitwiseAND(0x3F).bitwiseOR(0x80))
        two = F.concat(byte(F.shiftright(n, 6).bitwiseOR(0xC0)), tail(0))
        three = F.concat(byte(F.shiftright(n, 12).bitwiseOR(0xE0)), tail(6), tail(0))
        four = F.concat(byte(F.shiftright(n, 18).bitwiseOR(0xF0)), tail(12), tail(6), tail(0))
        return F.when(n < 0x80, one(byte(n))).when(n < 0x800, one(two)).when(surrogate | (n > 0x10FFFF), F.lit("�")).when(n < 0x10000, one(three)).otherwise(one(four))

    return F.array_join(F.transform(plain, lambda x, k: F.concat(x, F.coalesce(F.get(F.transform(F.slice(codes, k + 1, 1), char), F.lit(0)), F.lit("")))), "")


def strip(html: Column) -> Column:
    """Markup to text."""
    for name in ("script", "style", "noscript"):
        html = F.regexp_replace(html, rf"(?is)<{name}.*?</{name}>", " ")
    return collapse(decode(F.regexp_replace(html, r"<[^>]+>", " ")))


def strip_tags(html: Column) -> Column:
    """Tags only; script bodies stay."""
    return collapse(F.regexp_replace(html, r"<[^>]*>", " "))


def attr(tag: Column, name: str) -> Column:
    """The value of an attribute, '' if there is none."""
    quoted, bare = rf"(?i){name}\s*=\s*[\"']([^\"']*)[\"']", rf"(?i){name}\s*=\s*([^\s>]+)"
    return F.coalesce(F.when(F.rlike(tag, F.lit(quoted)), F.regexp_extract(tag, quoted, 1)).otherwise(F.regexp_extract(tag, bare, 1)), F.lit(""))


def has_attr(tag: Column, name: str) -> Column:
    return F.rlike(tag, F.lit(rf"(?i)\s{name}(?:\s*=|\s|>)"))


def tags(html: Column, name: str) -> Column:
    """All opening tags of a name, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), 0)


def first(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def meta(metas: Column, key: str, value: str) -> Column:
    """The content of the first meta tag whose key has the value; metas: the array of tags."""
    return first(F.transform(F.filter(metas, lambda t: F.lower(attr(t, key)) == value.lower()), lambda t: attr(t, "content")))


def link_rel(links: Column, rel: str) -> Column:
    """The href of the first link tag among whose rel tokens is rel."""
    return first(F.transform(F.filter(links, lambda t: F.array_contains(F.split(F.lower(attr(t, "rel")), r"\s+"), rel)), lambda t: attr(t, "href")))


def title(html: Column) -> Column:
    """E06."""
    return strip(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def h1(html: Column) -> Column:
    """Stripped, not empty."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h1\b[^>]*>(.*?)</h1>"), 1), strip), lambda x: x != "")


def headings(html: Column) -> Column:
    """Level and text in document order; the closing tag has the same level."""
    found = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>"
    levels, texts = (F.regexp_extract_all(html, F.lit(found), k) for k in (1, 2))
    return F.zip_with(levels, texts, lambda n, t: F.struct(n.cast("int").alias("level"), strip(t).alias("text")))


def word_count(text: Column) -> Column:
    """Tokens of stripped text."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def strip_markdown_links(c: Column) -> Column:
    """Links as their text, blanks collapsed and trimmed."""
    return collapse(F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1"))


def microdata_types(html: Column) -> Column:
    """In order, repeats included."""
    return F.regexp_extract_all(html, F.lit(r"(?i)itemtype\s*=\s*[\"']https?://schema\.org/([^\"']+)[\"']"), 1)


def rdfa_types(html: Column) -> Column:
    """Any typeof, in script code too; in order, repeats included."""
    values = F.regexp_extract_all(html, F.lit(r"(?i)typeof\s*=\s*[\"']([^\"']+)[\"']"), 1)
    return F.filter(F.flatten(F.transform(values, lambda v: F.split(v, r"\s+"))), lambda x: x != "")


def escape_html(c: Column) -> Column:
    """E22."""
    for mark, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(said))
    return c


def excerpt(text: Column, n: int = EXCERPT) -> Column:
    """E12."""
    return F.substring(text, 1, n)


def site_name(name_in_data: Column, page_title: Column) -> Column:
    """The name that structured data gives, else the title up to a bar or dash, else a default."""
    head = F.get(F.split(page_title, r"[|–—-]", -1), F.lit(0))
    return strip(F.coalesce(F.nullif(name_in_data, F.lit("")), F.nullif(head, F.lit("")), F.lit("Website")))


def ellipsis(c: Column, n: int) -> Column:
    """At most n characters, the last of which tells that more was there."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)
