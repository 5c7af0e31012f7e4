"""URL and domain expressions (R01-R10, E05, P04-P06): Column in, Column out, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of two labels, under which three labels make a domain.
TWO_PART_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "net.au", "org.au", "co.nz", "com.pk", "net.pk", "org.pk", "com.br", "co.in"]
#: The fewer suffixes that an import knows.
IMPORT_SUFFIXES = ["co.uk", "org.uk", "com.au", "co.nz", "com.pk", "org.pk", "net.pk", "co.in"]
#: What a cell holds when it holds nothing.
PLACEHOLDERS = ["n/a", "na", "null", "undefined", "-", "—"]
#: Roots of search engines, which are no sources of links.
SEARCH_ROOTS = ["duckduckgo.com", "bing.com", "microsoft.com", "yahoo.com", "google.com", "googleusercontent.com"]

_RELATIVE = r"(?is)^(?![a-z][a-z0-9+.-]*:)(?!//)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    """Lower-cased, without credentials and port; '' if there is none."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", ""), F.lit(""))


def origin(url: Column) -> Column:
    """Scheme, host and port that is not the default."""
    port = F.regexp_extract(authority(url), r":(\d+)$", 1)
    default = F.when(scheme(url) == "https", "443").when(scheme(url) == "http", "80").otherwise("")
    return F.concat(scheme(url), F.lit("://"), host(url), F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise(""))


def same_origin(a: Column, b: Column) -> Column:
    """P04."""
    return (host(a) != "") & (origin(a) == origin(b))


def root_domain(name: Column, suffixes: list[str] | None = None) -> Column:
    """The last two labels, or three under a suffix of two."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"^www\.", "")
    labels = F.filter(F.split(plain, r"\.", -1), lambda x: x != "")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).when(last(2).isin(suffixes or TWO_PART_SUFFIXES), last(3)).otherwise(last(2))


def host_from(c: Column) -> Column:
    """The host of a property name or URL."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^sc-domain:", "")
    return F.regexp_replace(F.when(plain.contains("://"), host(plain)).otherwise(F.regexp_replace(plain, r"[/?#].*$", "")), r"^www\.", "")


def normalise(url: Column) -> Column:
    """Without fragment, scheme and host lower-cased, a slash after a bare host; what does not parse stays."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    parsed = F.rlike(bare, F.lit(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#\s]+([/?].*)?$"))
    rest = F.regexp_replace(bare, r"(?is)^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    return F.when(parsed, F.concat(origin(bare), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))).otherwise(url)


def clean_cell(c: Column) -> Column:
    """Without byte-order mark, zero-width characters, one outer quote at either end, and blanks."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\x{FEFF}|[\x{200B}-\x{200D}\x{2060}]", "")
    trimmed = lambda x: F.regexp_replace(x, r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$", "")
    return trimmed(F.regexp_replace(trimmed(plain), r"^[\"']|[\"']$", ""))


def import_url(c: Column) -> Column:
    """A cell as a URL without fragment, '' if it is none.  A scheme is added to what looks like a host name."""
    cell = clean_cell(c)
    bare = F.rlike(cell, F.lit(r"(?i)^(?:www\.)?[a-z0-9][a-z0-9.-]+\.[a-z]{2,}(?:[/:?#].*)?$"))
    full = F.when(F.startswith(cell, F.lit("//")), F.concat(F.lit("https:"), cell)).when(~F.rlike(cell, F.lit(r"(?i)^https?://")) & bare, F.concat(F.lit("https://"), cell)).otherwise(cell)
    usable = ~F.lower(cell).isin(["", *PLACEHOLDERS]) & F.rlike(full, F.lit(r"(?is)^https?://[^/?#\s]+([/?#].*)?$")) & (host(full) != "")
    return F.when(usable, F.replace(normalise(full), F.lit(" "), F.lit("%20"))).otherwise("")


def import_domain(c: Column, suffixes: list[str] | None = None) -> Column:
    """A cell as a root domain, '' if it is none."""
    cell = F.lower(clean_cell(c))
    name = F.regexp_replace(F.regexp_replace(cell, r"^https?://", ""), r"[/?#:].*$", "")
    root = root_domain(name, suffixes or IMPORT_SUFFIXES)
    return F.when(~F.rlike(cell, F.lit(r"[\s@]")) & F.rlike(root, F.lit(r"^[a-z0-9.-]+\.[a-z]{2,}$")), root).otherwise("")


def query_value(url: Column, name: str) -> Column:
    """A parameter of a query, decoded; '' if it is missing."""
    raw = F.regexp_extract(url, rf"(?i)[?&]{name}=([^&#]*)", 1)
    return F.coalesce(F.try_url_decode(raw), F.lit(""))


def unwrap(url: Column) -> Column:
    """What a search engine's redirect points at; others stay."""
    full = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    uddg, ru = query_value(full, "uddg"), F.coalesce(F.try_url_decode(F.regexp_extract(full, r"/RU=([^/]+)", 1)), F.lit(""))
    return F.when(uddg != "", uddg).when((ru != "") & (root_domain(host(full)) == "yahoo.com"), ru).otherwise(full)


def candidate(url: Column, own_root: Column, blocked: list[str] | None = None) -> Column:
    """A usable link source, null if it is none."""
    target = unwrap(url)
    root = root_domain(host(target))
    ok = scheme(target).isin("http", "https") & (host(target) != "") & ~root.isin(blocked or SEARCH_ROOTS) & (root != own_root)
    return F.when(ok, F.regexp_replace(target, r"(?s)#.*$", ""))


def base_parts(base: Column) -> Column:
    """What `absolute` needs of a base, to be computed once a row."""
    path = F.regexp_replace(F.regexp_replace(base, r"(?is)^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"(?s)[?#].*$", "")
    path = F.when(path == "", "/").otherwise(path)
    return F.struct(F.when(host(base) != "", origin(base)).otherwise("").alias("origin"), scheme(base).alias("scheme"), path.alias("path"), F.regexp_replace(path, r"[^/]*$", "").alias("folder"), F.regexp_extract(base, r"(\?[^#]*)", 1).alias("query"))


def resolve(hrefs: Column, base: Column) -> Column:
    """E05 for an array of references: each resolved against base_parts, '' if that fails.

    Every intermediate is bound by a lambda of its own, so that it is computed once and not wherever it is named."""
    plain = F.transform(hrefs, lambda h: F.regexp_replace(F.coalesce(h, F.lit("")), r"^\s+|\s+$", ""))
    parted = F.transform(plain, lambda h: F.struct(h.alias("h"), F.regexp_extract(h, r"(?s)^([^?#]*)", 1).alias("path"), F.regexp_replace(h, r"(?s)^[^?#]*", "").alias("rest")))

    def own(h: Column) -> Column:
        return F.concat(origin(h), fold_dots(F.regexp_extract(h, r"(?is)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)), F.regexp_replace(h, r"(?is)^[a-z][a-z0-9+.-]*://[^/?#]*[^?#]*", ""))

    def one(x: Column) -> Column:
        h, path, rest = x["h"], x["path"], x["rest"]
        bare = F.concat(base["path"], F.when(F.startswith(rest, F.lit("?")), "").otherwise(base["query"]), rest)
        inner = F.when(path == "", bare).when(F.startswith(path, F.lit("/")), F.concat(fold_dots(path), rest)).otherwise(F.concat(fold_dots(F.concat(base["folder"], path)), rest))
        return (
            F.when(F.rlike(h, F.lit(r"(?i)^https?://[^/?#\s]+")), own(h))
            .when(F.rlike(h, F.lit(r"(?i)^[a-z][a-z0-9+.-]*:")), F.when(base["origin"] != "", h).otherwise(""))
            .when(base["origin"] == "", "")
            .when(F.startswith(h, F.lit("//")), own(F.concat(base["scheme"], F.lit(":"), h)))
            .otherwise(F.concat(base["origin"], inner))
        )

    return F.transform(parted, one)


def absolute(href: Column, base: Column) -> Column:
    """E05 for one reference against a base URL."""
    return resolve(F.array(href), base_parts(base))[0]


def fold_dots(path: Column) -> Column:
    """A path without . and .. segments; there is always a leading slash."""
    plain = F.concat(F.lit("/"), F.regexp_replace(path, r"^/", ""))

    def folded(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
        ends = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, ends).otherwise(""))

    dotted = F.rlike(path, F.lit(r"(^|/)\.\.?(/|$)"))
    return F.when(dotted, F.transform(F.array(F.split(F.regexp_replace(path, r"^/", ""), "/", -1)), folded)[0]).otherwise(plain)


def private_address(name: Column) -> Column:
    """Whether an address must not be fetched; what is no address counts as private."""
    v4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    a, b, c, d = (F.regexp_extract(name, v4, k).try_cast("int") for k in (1, 2, 3, 4))
    four = (
        (F.greatest(a, b, c, d) > 255) | a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & (c == 0)) | ((a == 198) & b.isin(18, 19)) | (a >= 224)
    )
    six = F.lower(F.regexp_replace(name, r"[\[\]]", ""))
    six_private = six.isin("::", "::1") | F.rlike(six, F.lit(r"^(fc|fd|fe80:|::ffff:(127|10|192\.168)\.)"))
    return F.when(F.rlike(name, F.lit(v4)), F.coalesce(four, F.lit(True))).when(F.rlike(six, F.lit(r"^[0-9a-f:.]*:[0-9a-f:.]*$")), six_private).otherwise(True)


def public_url(c: Column) -> Column:
    """A URL that may be fetched, null if it may not; a scheme is added if none is there."""
    full = F.when(F.rlike(c, F.lit(r"(?i)^[a-z][a-z0-9+.-]*://")), c).otherwise(F.concat(F.lit("https://"), c))
    h = host(full)
    address = F.rlike(h, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")) | F.startswith(h, F.lit("["))
    ok = scheme(full).isin("http", "https") & (h != "") & ~authority(full).contains("@") & (h != "localhost") & ~F.endswith(h, F.lit(".localhost")) & ~F.endswith(h, F.lit(".local")) & ~(address & private_address(h))
    return F.when(ok, normalise(full))


def search_queries(name: Column) -> Column:
    """Queries that look for links to a host."""
    return F.array(F.format_string('"%s" -site:%s', name, name), F.format_string('"https://%s" OR "http://%s" -site:%s', name, name, name))


def valid_query(query: Column, name: Column) -> Column:
    """A suggested query with blanks folded, or '' if it is empty, too long, or does not name the host."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " "), "^ | $", "")
    return F.when((F.length(plain) <= 180) & F.lower(plain).contains(F.lower(name)), plain).otherwise("")


def query_plan(name: Column, suggested: Column, most: int = 4) -> Column:
    """The own queries and the valid ones of an array of suggestions, once each, the first `most`."""
    valid = F.filter(F.transform(suggested, lambda q: valid_query(q, name)), lambda q: q != "")
    return F.slice(F.array_distinct(F.concat(search_queries(name), valid)), 1, most)
