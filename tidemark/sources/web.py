"""Crawl inputs (S03-S08, S15-S18): robots files, sitemaps, search results, registry and archive records, as tables of fetched text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import trim
from tidemark.functions.urls import candidate, root_domain, same_origin
from tidemark.sources.kept import kept

#: Fixed value: a year as registries count it.
YEAR_SECONDS = 31_557_600


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Robots (origin, body) to the sitemaps they name; the last named is read first."""
    rows = robots.select("origin", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?im)^sitemap:\s*(.+)$"), 1)).alias("ord", "url"))
    return rows.select("origin", trim(F.col("url")).alias("url"), (-F.col("ord")).alias("ord"))


def locs(body: Column) -> Column:
    """S07."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda x: F.replace(trim(x), F.lit("&amp;"), F.lit("&")))


def sitemap_urls(seeds: DataFrame, files: DataFrame, max_seeds: int | None = None, max_files: int | None = None) -> DataFrame:
    """Seeds (url, ord) and fetched files (url, body) to page URLs of the seeds' origins, in order of first sight.

    Index files are followed level by level, until a level has none that was not seen; every level is one join with the files
    not yet seen, and is kept as a checkpoint.  Caps are parameters, and none is set by default; the three crawlers that this
    covers differ in them only."""
    level = seeds.orderBy("ord", "url").limit(max_seeds) if max_seeds else seeds
    level = level.select("url", F.lpad(F.col("ord").cast("string"), 10, "0").alias("path"))
    seen = None
    while True:
        got = level.groupBy("url").agg(F.min("path").alias("path"))
        if seen is not None:
            got = got.join(seen.select("url"), "url", "left_anti")
        got = kept(got.join(files, "url").select("url", "path", "body"))
        seen = got if seen is None else seen.union(got)
        level = got.where(F.rlike("body", F.lit("(?i)<sitemapindex"))).select(F.col("url").alias("parent"), "path", F.posexplode(locs(F.col("body"))).alias("k", "url"))
        level = level.where(same_origin(F.col("url"), F.col("parent"))).select("url", F.concat_ws("/", "path", F.lpad(F.col("k").cast("string"), 10, "0")).alias("path"))
        if not level.limit(1).count():
            break
    if max_files:
        seen = seen.orderBy("path", "url").limit(max_files)
    rows = seen.where(~F.rlike("body", F.lit("(?i)<sitemapindex"))).select(F.col("url").alias("file"), "path", F.posexplode(locs(F.col("body"))).alias("k", "url"))
    rows = rows.where(same_origin(F.col("url"), F.col("file"))).select("url", F.concat_ws("/", "path", F.lpad(F.col("k").cast("string"), 10, "0")).alias("ord"))
    return rows.groupBy("url").agg(F.min("ord").alias("ord"))


def discover(start: DataFrame, listed: DataFrame, page_links: DataFrame, max_pages: int) -> DataFrame:
    """Start and listed URLs, or links of the page if nothing is listed; without fragment, once each, in order."""
    pool = listed.unionByName(page_links.join(listed.limit(1).select(F.lit(1).alias("_x")), F.lit(True), "left_anti"))
    rows = start.select("url", F.lit("").alias("ord")).unionByName(pool.select("url", "ord")).withColumn("url", F.regexp_replace("url", "(?s)#.*$", ""))
    return rows.groupBy("url").agg(F.min("ord").alias("ord")).orderBy("ord", "url").limit(max(1, min(500, max_pages)))


def search_results(results: DataFrame) -> DataFrame:
    """Results (engine, target, body) to usable links, in order, once each."""
    duck = F.concat(F.regexp_extract_all("body", F.lit(r"(?is)<a\b[^>]*class=\"[^\"]*result__a[^\"]*\"[^>]*href=\"([^\"]+)\""), 1), F.regexp_extract_all("body", F.lit(r"(?is)<a\b[^>]*href=\"([^\"]+)\"[^>]*class=\"[^\"]*result__a[^\"]*\""), 1))
    bing = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<li\b[^>]*class=\"[^\"]*b_algo[^\"]*\"[^>]*>(.*?)</li>"), 1), lambda x: F.regexp_extract(x, r"(?is)<a\b[^>]*href=\"([^\"]+)\"", 1))
    rows = results.select("engine", "target", F.posexplode(F.when(F.col("engine") == "bing", bing).otherwise(duck)).alias("ord", "href"))
    rows = rows.withColumn("url", candidate(F.replace("href", F.lit("&amp;"), F.lit("&")), root_domain(F.col("target")))).where("url is not null")
    return rows.groupBy("engine", "target", "url").agg(F.min("ord").alias("ord"))


def domain_age(registry: DataFrame, as_of: str) -> DataFrame:
    """Registry (domain, body) to the first registration and whole years since."""
    from tidemark.functions.numbers import age_label

    events = F.from_json("body", "struct<events:array<struct<eventAction:string,eventDate:string>>>")["events"]
    first = F.get(F.filter(events, lambda e: e["eventAction"].isin("registration", "registered")), F.lit(0))["eventDate"]
    years = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(first.try_cast("timestamp"))) / YEAR_SECONDS
    years = F.when(years.isNotNull(), F.greatest(F.lit(0.0), years))
    return registry.select("domain", first.alias("registered"), years.alias("years")).withColumn("label", F.when(F.col("years").isNotNull(), age_label(F.col("years"))))


def archive_rows(lines: DataFrame, n: int = 20) -> DataFrame:
    """Lines (domain, line, ord) of JSON to records; lines that do not parse are dropped; n for each domain."""
    rows = lines.select("domain", "ord", F.from_json("line", "struct<url:string,timestamp:string,status:string,mime:string>").alias("x")).where("x.url is not null")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("ord"))).where(F.col("_n") <= n).select("domain", "x.*", "ord")


def domain_ranks(domains: DataFrame, ranks: DataFrame) -> DataFrame:
    """Each domain with its rank, or why there is none."""
    return domains.join(ranks, "domain", "left").withColumn("reason", F.when(F.col("page_rank").isNull(), "not ranked"))
