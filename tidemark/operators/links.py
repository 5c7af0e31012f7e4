"""Link evidence (J11, J13, P07, P08, P12, U03, U05, A05-A12, K08, K09, K19, K20): candidates to verified rows, groups and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp, round_half_up
from tidemark.functions.urls import host, root_domain


def live(row_live: Column, no_link: Column) -> Column:
    """An unknown flag counts as not set."""
    return F.coalesce(row_live, F.lit(False)) & ~F.coalesce(no_link, F.lit(False))


def follow(rel: Column) -> Column:
    """Rel says nothing against it."""
    return ~F.rlike(F.lower(F.coalesce(rel, F.lit(""))), F.lit("nofollow|sponsored|ugc"))


def verify(pages: DataFrame, target_root: str) -> DataFrame:
    """For each page its first link to the target's domain, or a row that says there is none, or the error of a page
    that could not be read.  Pages of the target's own domain are left out.

    pages: final_url, status, links, and error if there are failed ones.  The match is found within the page's array;
    nothing is exploded."""
    hit = F.get(F.filter("links", lambda x: root_domain(host(x["url"])) == target_root), F.lit(0))
    failed = F.col("error").cast("string") if "error" in pages.columns else F.lit(None).cast("string")
    hit = F.when(failed.isNull(), hit)
    rows = pages.select(F.col("final_url").alias("source_url"), root_domain(host(F.col("final_url"))).alias("source_domain"), F.col("status").alias("http_status"), hit.alias("x"), failed.alias("error"))
    none = F.col("x").isNull() & F.col("error").isNull()
    rows = rows.where(F.col("error").isNotNull() | (F.col("source_domain") != target_root))
    own = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    rel, ok = F.lower(F.col("x.rel")), F.col("http_status").between(200, 299)
    return rows.select(
        "source_url", own("source_domain"), F.col("x.url").alias("target_url"), F.coalesce(F.substring("x.anchor", 1, 180), F.lit("")).alias("anchor"), F.coalesce(rel, F.lit("")).alias("rel"),
        (F.col("x").isNotNull() & follow(rel)).alias("follow"), F.coalesce(F.col("x").isNotNull() & ok, F.lit(False)).alias("live"), none.alias("no_link_found"), own("http_status"), "error",
    )


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; order must be total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with the place of the first."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("x"), F.min(order).alias("first_at")).select(key, *[f"x.{c}" for c in others], "first_at")


def dedupe(rows: DataFrame) -> DataFrame:
    """U03 over source, target and anchor: rows are compared whole where the order ties, so the result is one."""
    return first_of_each(rows, ["source_url", "target_url", "anchor"], [F.desc("live"), F.asc_nulls_last("http_status"), F.asc("rel")])


def merge_batches(*batches: DataFrame) -> DataFrame:
    """Batches are united and deduplicated as a whole; summaries are made of the result."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return dedupe(out)


def grouped(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Counts, largest first, ties by key."""
    out = rows.groupBy(key).agg(F.count("*").alias("links")).orderBy(F.desc("links"), key)
    return out.limit(n) if n else out


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts, the follow ratio and the concentration, by two levels of aggregation."""
    is_live = live(F.col("live"), F.col("no_link_found"))
    domain = rows.withColumn("_live", is_live).groupBy("source_domain").agg(F.count("*").alias("n"), F.count_if("_live").alias("l"), F.count_if(F.col("_live") & F.col("follow")).alias("f"))
    return summary_of_domains(domain)


def summary_of_domains(domain: DataFrame) -> DataFrame:
    """The summary from the counts of each source_domain: n links, l live ones, f live ones to follow."""
    one = domain.agg(F.sum("n").alias("candidates"), F.sum("l").alias("live"), F.count_if(F.col("l") > 0).alias("domains"), F.sum("f").alias("follow"), F.max("l").alias("largest"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    n_live = zero("live")
    share = lambda c: F.when(n_live == 0, 0.0).otherwise(zero(c) / F.greatest(n_live, F.lit(1)))
    return one.select(
        zero("candidates").alias("candidates"), n_live.alias("live"), zero("domains").alias("domains"), zero("follow").alias("follow"), (n_live - zero("follow")).alias("nofollow"),
        (zero("candidates") - n_live).alias("unverified"), share("follow").alias("follow_ratio"), share("largest").alias("concentration"),
    )


def authority(s: DataFrame, page_rank: float = 0.0) -> DataFrame:
    """A summary row with its score and how far the evidence bears it."""
    raw = 8 * F.col("domains") + F.least(F.lit(22), 2 * F.col("live")) + 16 * F.col("follow_ratio") + 4 * F.lit(float(page_rank)) - F.greatest(F.lit(0.0), 28 * (F.col("concentration") - 0.45))
    score = F.when(F.col("live") == 0, 0).otherwise(clamp(round_half_up(raw))).cast("long")
    return s.withColumn("authority", score).withColumn("confidence", confidence(F.col("candidates"), F.col("live")))


def confidence(candidates: Column, n_live: Column) -> Column:
    """K09."""
    return F.when(candidates == 0, "Insufficient evidence").when(n_live >= 20, "High").when(n_live >= 5, "Medium").otherwise("Low")


def authority_fallback(page_rank: Column) -> Column:
    """K20."""
    return F.coalesce(F.least(F.lit(100.0), page_rank * 20), F.lit(35.0))


#: What an error message says, in the order in which it is looked for.
ERROR_KINDS = [
    ("quota", r"RESOURCE_EXHAUSTED|quota|rate limit|billing details|429"),
    ("temporary", r"UNAVAILABLE|overloaded|temporarily unavailable|503"),
    ("credentials", r"API key|PERMISSION_DENIED|UNAUTHENTICATED|permission|401|403"),
    ("model", r"model .*not found|NOT_FOUND|no longer available|404"),
    ("network", r"timed out|AbortError|network|fetch failed"),
]


def error_kind(message: Column) -> Column:
    """K19."""
    out = F.lit("other")
    for kind, pattern in reversed(ERROR_KINDS):
        out = F.when(F.rlike(F.coalesce(message, F.lit("")), F.lit(f"(?i){pattern}")), F.lit(kind)).otherwise(out)
    return out


def match_properties(properties: DataFrame, target: Column) -> DataFrame:
    """Properties (id, urls) with whether one of their URLs has the target's root domain; equal hosts have equal
    roots, so the test is on roots alone.  Recommended ones come first."""
    root = root_domain(target)
    out = properties.withColumn("recommended", F.exists("urls", lambda u: root_domain(F.regexp_replace(F.when(u.contains("://"), host(u)).otherwise(F.regexp_replace(F.lower(u), "^sc-domain:", "")), r"^www\.", "")) == root))
    return out.orderBy(F.desc("recommended"), "id")


def properties(accounts: DataFrame) -> DataFrame:
    """Accounts (account, properties: array of structs with id, name and streams) to one row for each property,
    with the URLs of its web streams."""
    rows = accounts.select("account", F.explode("properties").alias("p"))
    web = F.transform(F.filter("p.streams", lambda s: s["type"] == "WEB_DATA_STREAM"), lambda s: s["uri"])
    return rows.select(F.col("p.id").alias("id"), F.col("p.name").alias("name"), "account", F.array_distinct(web).alias("urls"))
