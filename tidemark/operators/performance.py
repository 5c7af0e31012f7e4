"""Performance lab (S09, S10, K10-K15, L01, J09, J10, N07, P11, A23): measurement JSON to buckets and ranked diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import category_score, diagnostic_status, metric_bucket, score_bucket
from tidemark.functions.text import strip_markdown_links

AUDIT = "struct<title:string,description:string,score:double,scoreDisplayMode:string,numericValue:double,displayValue:string,details:struct<overallSavingsMs:double,overallSavingsBytes:double,items:array<struct<url:string,source:string,node:struct<snippet:string,selector:string>,totalBytes:double,wastedBytes:double,wastedMs:double>>>>"
LAB = f"struct<lighthouseResult:struct<categories:map<string,struct<score:double>>,audits:map<string,{AUDIT}>>>"
FIELD = "struct<record:struct<metrics:map<string,struct<percentiles:struct<p75:string>>>>>"
#: Lab audits and field measurements of the metrics.
LAB_METRICS = {"LCP": "largest-contentful-paint", "CLS": "cumulative-layout-shift", "FCP": "first-contentful-paint", "TBT": "total-blocking-time", "TTFB": "server-response-time"}
FIELD_METRICS = {"LCP": "largest_contentful_paint", "INP": "interaction_to_next_paint", "CLS": "cumulative_layout_shift", "FCP": "first_contentful_paint", "TTFB": "experimental_time_to_first_byte"}
#: Which diagnostics explain a metric, most telling first.
CAUSES = {
    "LCP": ["largest-contentful-paint-element", "server-response-time", "render-blocking-resources", "uses-optimized-images", "uses-responsive-images"],
    "CLS": ["layout-shifts"],
    "INP": ["long-tasks", "bootup-time", "mainthread-work-breakdown", "unused-javascript"],
}
#: Of which diagnostics the highest ranked one is taken.
RANKED_CAUSES = {
    "LCP": ["largest-contentful-paint-element", "server-response-time", "render-blocking-resources"],
    "CLS": ["layout-shifts"],
    "INP": ["long-tasks", "unused-javascript", "bootup-time", "mainthread-work-breakdown"],
}
#: The audits that are diagnostics, in their order.
AUDITS = [
    "largest-contentful-paint-element", "layout-shifts", "unused-css-rules", "unused-javascript", "render-blocking-resources", "long-tasks",
    "bootup-time", "mainthread-work-breakdown", "server-response-time", "offscreen-images", "uses-optimized-images", "uses-responsive-images",
]
#: What mends a diagnostic; others get a general advice.
FIXES = {
    "unused-css-rules": "Remove unused selectors, split page-specific CSS, purge framework output, and load non-critical styles after the first render.",
    "unused-javascript": "Remove unused bundles, tree-shake dependencies, code-split by route, delay third-party scripts, and load non-critical JavaScript after interaction.",
    "render-blocking-resources": "Inline critical CSS, defer non-critical styles, add defer/async to safe scripts, and preload only the resources required above the fold.",
    "largest-contentful-paint-element": "Optimise and preload the LCP asset, reduce server response time, avoid lazy-loading the hero image, and remove render-blocking work before it paints.",
    "layout-shifts": "Reserve width and height for images, embeds and ads; avoid inserting content above existing elements; and stabilise fonts with appropriate preload and fallback metrics.",
    "long-tasks": "Break long JavaScript tasks into smaller work, reduce main-thread execution, move heavy processing to web workers, and delay optional scripts.",
    "bootup-time": "Reduce JavaScript parse and execution cost, ship smaller bundles, remove duplicate libraries, and defer third-party code.",
    "mainthread-work-breakdown": "Reduce script evaluation, style recalculation and layout work; simplify DOM structure and limit expensive client-side rendering.",
    "server-response-time": "Improve hosting, caching, database queries and backend processing; use a CDN and full-page caching where appropriate.",
    "offscreen-images": "Lazy-load below-the-fold images while keeping the hero/LCP image eager.",
    "uses-optimized-images": "Compress images, use AVIF/WebP, resize to rendered dimensions and avoid oversized originals.",
    "uses-responsive-images": "Use srcset and sizes so each device downloads an appropriately sized image.",
}
#: Fixed value: the general advice.
ADVICE = "Review the affected resources and reduce the work required before the page becomes stable and interactive."
#: Fixed value: items that are read of a diagnostic.
ITEMS = 30


def lab(documents: DataFrame) -> DataFrame:
    """documents (url, strategy, body) with `lab`, parsed by a fixed schema; a body that does not parse gives null."""
    return documents.select("url", "strategy", F.from_json("body", LAB)["lighthouseResult"].alias("lab"))


def category_scores(parsed: DataFrame) -> DataFrame:
    """A row for each category."""
    rows = parsed.select("url", "strategy", F.explode("lab.categories").alias("category", "x"))
    return rows.select("url", "strategy", "category", category_score(F.col("x.score")).alias("score")).withColumn("bucket", score_bucket(F.col("score")))


def lab_metrics(parsed: DataFrame) -> DataFrame:
    """A row for each metric; what was not measured is unknown."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.try_element_at(F.col("lab.audits"), F.lit(a))["numericValue"].alias("value")) for m, a in LAB_METRICS.items()])
    return parsed.select("url", "strategy", F.inline(each)).withColumn("bucket", metric_bucket(F.col("metric"), F.col("value")))


def field_metrics(documents: DataFrame) -> DataFrame:
    """p75 for each metric, which may be text; missing ones are null."""
    parsed = documents.select("url", F.from_json("body", FIELD)["record"]["metrics"].alias("m"))
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.try_element_at(F.col("m"), F.lit(f))["percentiles"]["p75"].try_cast("double").alias("value")) for k, f in FIELD_METRICS.items()])
    return parsed.select("url", F.inline(each)).withColumn("bucket", metric_bucket(F.col("metric"), F.col("value")))


def vitals_passed(metrics: DataFrame) -> DataFrame:
    """Whether all of LCP, INP and CLS are good; null without any field data."""
    vital = F.col("metric").isin("LCP", "INP", "CLS")
    return metrics.groupBy("url").agg(F.when(F.count("value") > 0, F.coalesce(F.every(F.when(vital, F.col("bucket") == "good")), F.lit(False))).alias("passed"))


def impact(ms: Column, size: Column) -> Column:
    """K14."""
    return F.greatest(F.coalesce(ms, F.lit(0.0)), F.coalesce(size, F.lit(0.0)) / 1000, F.lit(1.0))


def impact_width(rows: DataFrame, value: str) -> DataFrame:
    """The relative width of each row's bar."""
    most = F.max(value).over(Window.partitionBy("url"))
    return rows.withColumn("width", F.greatest(F.lit(8.0), F.least(F.lit(100.0), F.col(value) / most * 100)))


def fix_for(audit: Column) -> Column:
    """K15."""
    out = F.lit(ADVICE)
    for name, said in FIXES.items():
        out = F.when(audit == name, said).otherwise(out)
    return out


def diagnostics(parsed: DataFrame, audits: list[str] | None = None) -> DataFrame:
    """Audits that leave something to do, ranked by what they would save; ties keep their order."""
    listed = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(x).alias("id"), F.try_element_at(F.col("lab.audits"), F.lit(x)).alias("a")) for k, x in enumerate(audits or AUDITS)])
    rows = parsed.select("url", "strategy", F.inline(listed))
    rows = rows.where("a is not null and (a.score is null or a.score <> 1) and coalesce(a.scoreDisplayMode, '') <> 'notApplicable'")
    out = rows.select(
        "url", "strategy", "ord", "id", diagnostic_status(F.col("a.score")).alias("status"), F.coalesce(F.nullif("a.title", F.lit("")), "id").alias("title"), strip_markdown_links(F.col("a.description")).alias("description"), F.col("a.displayValue").alias("display_value"),
        F.coalesce("a.details.overallSavingsMs", F.lit(0.0)).alias("savings_ms"), F.coalesce("a.details.overallSavingsBytes", F.lit(0.0)).alias("savings_bytes"), fix_for(F.col("id")).alias("fix"), F.col("a.details.items").alias("items"),
    )
    return ranked(out)


def ranked(rows: DataFrame) -> DataFrame:
    """L01 within each document."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("url", "strategy").orderBy(F.desc(F.col("savings_ms") + F.col("savings_bytes") / 1000), "ord")))


def _causes(spark, causes: dict[str, list[str]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(m, i, k) for m, ids in causes.items() for k, i in enumerate(ids)], "metric string, id string, preference int"))


def primary_cause(found: DataFrame, causes: dict[str, list[str]] | None = None, by_rank: bool = False) -> DataFrame:
    """For each document and metric the most preferred diagnostic that is there; J10 (by_rank): the highest ranked
    of those listed."""
    hit = found.join(_causes(found.sparkSession, causes or (RANKED_CAUSES if by_rank else CAUSES)), "id")
    return hit.groupBy("url", "strategy", "metric").agg(F.min_by("id", "rank" if by_rank else "preference").alias("cause"))


def item_url(item: Column) -> Column:
    """What an item is about: its URL, else its source's URL, else the snippet of its node; '' if it names none."""
    chain = (item["url"], F.get_json_object(item["source"], "$.url"), item["node"]["snippet"])
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in chain], F.lit(""))


def resources(found: DataFrame, n: int = 100, each: int = ITEMS) -> DataFrame:
    """The first items of all diagnostics, those that name something; at most n for each document, in order."""
    rows = found.select("url", "strategy", "rank", "id", F.posexplode(F.slice("items", 1, each)).alias("pos", "i")).withColumn("resource", item_url(F.col("i"))).where("resource <> ''")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("url", "strategy").orderBy("rank", "pos"))).where(F.col("_n") <= n)
    return first.select("url", "strategy", "id", "resource", F.coalesce("i.totalBytes", F.lit(0.0)).alias("bytes"))
