"""Web-page extraction (S02, E01-E21, N01-N03): raw HTML rows to page rows, in one pass and without a shuffle.

The expensive expressions (stripped text, tag lists) are computed once in a first projection; a repartition of single-file
inputs is left to the caller, since a table of many files needs none.  An empty reference resolves to the page's own URL, so a
page without a canonical link is its own canonical, as surveyed.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import blocks

#: JSON-LD blocks that are read of a page.
MAX_BLOCKS = 100
_BLOCK = r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_ANCHOR = r"(?is)<a\b[^>]*>.*?</a>"


def images(html: Column, base: Column) -> Column:
    """Source with lazy-loading fallbacks, alternative text, size; without source, the page's own URL is the source, as an
    empty reference resolves to it.  base: base_parts."""
    src = lambda tag: F.coalesce(*[F.nullif(T.attr(tag, n), F.lit("")) for n in ("src", "data-src", "data-lazy-src")], F.lit(""))
    size = lambda tag, n: F.nullif(T.attr(tag, n).try_cast("double"), F.lit(0.0))
    tags = T.tags(html, "img")
    found = F.transform(tags, lambda tag: F.struct(tag.alias("tag"), T.attr(tag, "alt").alias("alt"), T.has_attr(tag, "alt").alias("has_alt"), size(tag, "width").alias("width"), size(tag, "height").alias("height"), T.attr(tag, "loading").alias("loading")))
    made = F.zip_with(found, U.resolve(F.transform(tags, src), base), lambda x, u: F.struct(u.alias("src"), x["alt"].alias("alt"), x["has_alt"].alias("has_alt"), x["width"].alias("width"), x["height"].alias("height"), x["loading"].alias("loading"), x["tag"].alias("tag")))
    return F.filter(made, lambda x: x["src"] != "")


def anchors(html: Column) -> Column:
    """Anchors, each as a whole, with its reference and rel."""
    whole = F.regexp_extract_all(html, F.lit(_ANCHOR), 0)
    return F.transform(whole, lambda tag: F.struct(T.attr(tag, "href").alias("href"), tag.alias("body"), T.attr(tag, "rel").alias("rel")))


def links(found: Column, base: Column) -> Column:
    """Resolved http(s) links with anchor text and rel; without a reference, a link to the page itself.
    found: anchors; base: base_parts."""
    made = F.zip_with(found, U.resolve(F.transform(found, lambda x: x["href"]), base), lambda x, u: F.struct(u.alias("url"), T.strip(x["body"]).alias("anchor"), x["rel"].alias("rel")))
    return F.filter(made, lambda x: F.rlike(x["url"], F.lit(r"^https?:")))


def raw_blocks(html: Column) -> Column:
    """Up to MAX_BLOCKS blocks."""
    return F.transform(F.slice(F.regexp_extract_all(html, F.lit(_BLOCK), 1), 1, MAX_BLOCKS), T.trim)


#: Optional columns of the input, with their types and what stands for them.
OPTIONAL = {"status": ("int", 200), "x_robots_tag": ("string", ""), "requested_url": ("string", None), "content_type": ("string", ""), "ms": ("long", None), "error": ("string", None)}


@lru_cache(maxsize=16)
def _expressions(app: str, html: str, url: str, given: tuple[str, ...]) -> tuple[list[Column], list[Column], dict[str, Column]]:
    """Two projections and the facts.  There are thousands of nodes, and each costs a call to the JVM, so they are built once
    for an application and kept."""
    h = F.coalesce(F.col("_h"), F.lit(""))

    def optional(c: str) -> Column:
        kind, other = OPTIONAL[c]
        return F.coalesce(F.col(f"_o_{c}"), F.lit(other).cast(kind)) if c in given else F.lit(other).cast(kind)

    passed = [F.col(c).cast(OPTIONAL[c][0]).alias(f"_o_{c}") for c in given]
    first = [F.col(html).alias("_h"), F.col(url).alias("_u"), U.base_parts(F.col(url)).alias("_base"), anchors(F.coalesce(F.col(html), F.lit(""))).alias("_anchors"), *passed]
    second = [
        F.col("_u"), F.col("_h"), F.col("_base"), T.strip(h).alias("_text"), T.tags(h, "meta").alias("_meta"), T.tags(h, "link").alias("_link"), links(F.col("_anchors"), F.col("_base")).alias("_links"),
        images(h, F.col("_base")).alias("_images"), raw_blocks(h).alias("_raw"), *[F.col(f"_o_{c}") for c in given],
    ]
    resolved = lambda c: U.resolve(F.array(c), F.col("_base"))[0]
    meta = lambda key, value: T.meta(F.col("_meta"), key, value)
    status, kind = optional("status"), optional("content_type")
    refused = status.between(200, 299) & (kind != "") & ~F.rlike(kind, F.lit(r"(?i)(text/html|application/xhtml\+xml)"))
    facts = {
        "requested_url": F.coalesce(optional("requested_url"), F.col("_u")),
        "final_url": F.col("_u"),
        "title": T.title(h),
        "description": meta("name", "description"),
        "robots": meta("name", "robots"),
        "x_robots_tag": optional("x_robots_tag"),
        "viewport": meta("name", "viewport"),
        "canonical": resolved(T.link_rel(F.col("_link"), "canonical")),
        "favicon": resolved(F.coalesce(F.nullif(T.link_rel(F.col("_link"), "icon"), F.lit("")), F.nullif(T.link_rel(F.col("_link"), "shortcut"), F.lit("")), F.lit("/favicon.ico"))),
        "lang": T.attr(F.regexp_extract(h, r"(?i)<html\b[^>]*>", 0), "lang"),
        "status": status,
        "ok": status.between(200, 299),
        "ms": optional("ms"),
        "content_type": kind,
        "error": F.coalesce(optional("error"), F.when(refused, F.concat(F.lit("The URL returned "), kind, F.lit(", not an HTML webpage.")))),
        "h1": T.h1(h),
        "headings": T.headings(h),
        "images": F.col("_images"),
        "links": F.col("_links"),
        "blocks": F.zip_with("_raw", F.col("_read")["valid"], lambda r, v: F.struct(r.alias("raw"), v.alias("valid"))),
        "schema_types": F.col("_read")["types"],
        "og": F.struct(*[(resolved if n in ("image", "url") else lambda c: c)(meta("property", f"og:{n}")).alias(n) for n in ("title", "description", "image", "url", "type")]),
        "twitter": F.struct(*[(resolved if n == "image" else lambda c: c)(meta("name", f"twitter:{n}")).alias(n) for n in ("card", "title", "description", "image")]),
        "word_count": T.word_count(F.col("_text")).cast("int"),
        "text_excerpt": T.excerpt(F.col("_text")),
        "site_name": T.site_name(F.col("_read")["name"], F.col("title")),
    }
    return first, second, facts


def page_facts(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """A page row for each HTML row; other columns pass through, and those named like a fact are replaced.

    Null HTML counts as empty.  Optional input columns: those of OPTIONAL.  A page that was not read, or is no HTML, has an error."""
    kept = [c for c in pages.columns if c != html]
    given = tuple(c for c in OPTIONAL if c in pages.columns)
    first, second, facts = _expressions(pages.sparkSession.sparkContext.applicationId, html, url, given)
    staged = pages.select("*", *first).select(*kept, *second).withColumn("_read", blocks.read("_raw"))
    facts, name = dict(facts), facts["site_name"]
    del facts["site_name"]
    out = staged.select(*[c for c in kept if c not in facts and c != "site_name"], *[x.alias(n) for n, x in facts.items()], "_read")
    return out.withColumn("site_name", name).drop("_read")
