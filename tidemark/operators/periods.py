"""Period-over-period reports (T01-T10, J01-J05, A17-A22, L04-L06, P10, P14, S11-S13): one pass over a daily fact table.

Each fact row is tagged current or previous, and conditional sums give both periods in one aggregation; the date range is
pushed to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import change, number, ratio

PAGE_SIZES, DEFAULT_PAGE = (25, 50, 100), 25
#: Report dimensions by source; what is unknown takes the first.
DIMENSIONS = {
    "search": {"query": "query", "page": "page", "country": "country", "device": "device", "appearance": "appearance", "date": "date"},
    "analytics": {"channel": "channel", "landing": "landing", "source": "source", "country": "country", "city": "city", "device": "device", "date": "date"},
}
PRESETS = (7, 28, 90, 180, 365)


@dataclass(frozen=True)
class Range:
    """Both days count."""

    start: date
    end: date

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError("a range starts after it ends")

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def previous(self) -> Range:
        """As many days, just before."""
        return Range(self.start - timedelta(days=self.days), self.start - timedelta(days=1))

    @classmethod
    def parse(cls, start: str, end: str) -> Range:
        return cls(date.fromisoformat(start), date.fromisoformat(end))


def compare_range(current: Range, start: str | None = None, end: str | None = None) -> Range:
    """Each side falls back on its own; what is then out of order falls back whole."""
    base = current.previous()

    def day(said: str | None, other: date) -> date:
        try:
            return date.fromisoformat(said) if said else other
        except ValueError:
            return other

    a, b = day(start, base.start), day(end, base.end)
    return Range(a, b) if a <= b else base


def preset(name: int | str, as_of: date) -> Range:
    """So many days that end on as_of, or "previous-month"."""
    if name == "previous-month":
        last = as_of.replace(day=1) - timedelta(days=1)
        return Range(last.replace(day=1), last)
    days = int(name) if int(name) in PRESETS else 28
    return Range(as_of - timedelta(days=days - 1), as_of)


def dimension(source: str, name: str) -> str:
    """T08."""
    known = DIMENSIONS[source]
    return known.get(name, next(iter(known.values())))


def tagged(facts: DataFrame, day: str, current: Range, previous: Range) -> DataFrame:
    """Rows of either period with booleans is_current and is_previous; periods may overlap."""
    inside = lambda r: (F.col(day) >= F.lit(r.start)) & (F.col(day) < F.lit(r.end + timedelta(days=1)))
    return facts.where(inside(current) | inside(previous)).withColumns({"is_current": inside(current), "is_previous": inside(previous)})


_SEARCH = "struct<rows:array<struct<keys:array<string>,clicks:string,impressions:string,ctr:string,position:string>>>"
_VALUE = "array<struct<value:string>>"
_ANALYTICS = f"struct<rows:array<struct<dimensionValues:{_VALUE},metricValues:{_VALUE}>>>"
#: Metrics of an analytics answer, in order.
ANALYTICS_METRICS = ["activeUsers", "newUsers", "sessions", "engagedSessions", "engagementRate", "views", "keyEvents", "engagementSeconds"]


def search_rows(answers: DataFrame, body: str = "body") -> DataFrame:
    """Answers of a search report (JSON text) to a row for each key; what is no number is 0.  Other columns pass through."""
    kept = [c for c in answers.columns if c != body]
    rows = answers.select(*kept, F.posexplode(F.from_json(body, _SEARCH)["rows"]).alias("ord", "x"))
    return rows.select(*kept, "ord", F.coalesce(F.get("x.keys", F.lit(0)), F.lit("")).alias("key"), *[number(F.col(f"x.{m}")).alias(m) for m in ("clicks", "impressions", "ctr", "position")])


def analytics_rows(answers: DataFrame, body: str = "body") -> DataFrame:
    """Answers of an analytics report (JSON text) to a row for each key, metrics by their place."""
    kept = [c for c in answers.columns if c != body]
    rows = answers.select(*kept, F.posexplode(F.from_json(body, _ANALYTICS)["rows"]).alias("ord", "x"))
    at = lambda k: number(F.get("x.metricValues", F.lit(k))["value"])
    return rows.select(*kept, "ord", F.coalesce(F.get("x.dimensionValues", F.lit(0))["value"], F.lit("")).alias("key"), *[at(k).alias(m) for k, m in enumerate(ANALYTICS_METRICS)])


def sums(columns: list[str]) -> list[Column]:
    """For each column its sums in both periods; null where no row is in the period."""
    return [F.sum(F.when(F.col(f"is_{p}"), F.col(c))).alias(f"{p}_{c}") for c in columns for p in ("current", "previous")]


def totals(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Metric triples as columns."""
    out = rows.agg(*sums(columns))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    return out.select(*[x for c in columns for x in (zero(f"current_{c}").alias(f"current_{c}"), zero(f"previous_{c}").alias(f"previous_{c}"), change(zero(f"current_{c}"), zero(f"previous_{c}")).alias(f"change_{c}"))])


def by_dimension(rows: DataFrame, key: str, columns: list[str], zero_fill: bool = True) -> DataFrame:
    """Keys of the current period with both periods and the change; a key without a past has zeros, or nulls
    if not zero_fill, and its change is against 0 either way.  One aggregation stands for the left join."""
    out = rows.groupBy(F.col(key).alias("key")).agg(F.count_if("is_current").alias("_n"), *sums(columns)).where("_n > 0")
    cur = lambda c: F.coalesce(F.col(f"current_{c}"), F.lit(0.0)).cast("double")
    raw = lambda c: F.col(f"previous_{c}").cast("double")
    prev = lambda c: F.coalesce(raw(c), F.lit(0.0))
    return out.select("key", *[x for c in columns for x in (cur(c).alias(f"current_{c}"), (prev(c) if zero_fill else raw(c)).alias(f"previous_{c}"), change(cur(c), prev(c)).alias(f"change_{c}"))])


def position_change(current: Column, previous: Column) -> Column:
    """An absolute difference; 0 without a past."""
    return F.when(previous.isNull() | (previous == 0), F.lit(0.0)).otherwise(current - previous)


def daily(rows: DataFrame, day: str, columns: list[str], period: str) -> DataFrame:
    """A18."""
    return rows.where(F.col(f"is_{period}")).groupBy(F.to_date(day).alias("day")).agg(*[F.sum(c).alias(c) for c in columns])


def aligned(rows: DataFrame, day: str, columns: list[str], current: Range, previous: Range) -> DataFrame:
    """Both daily series side by side by ordinal, not by date.  At most one row for each day of a range."""

    def numbered(period: str) -> DataFrame:
        return daily(rows, day, columns, period).withColumn("n", F.row_number().over(Window.orderBy("day"))).select("n", F.col("day").alias(f"{period}_day"), *[F.col(c).alias(f"{period}_{c}") for c in columns])

    return numbered("current").join(numbered("previous"), "n", "left")


def paged(rows: DataFrame, order: list[Column], page: int = 1, size: int = DEFAULT_PAGE) -> DataFrame:
    """The order must be total."""
    size = size if size in PAGE_SIZES else DEFAULT_PAGE
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def page_count(n: Column, size: int) -> Column:
    """L05."""
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("long")


def clamp_page(page: Column, pages: Column) -> Column:
    return F.greatest(F.lit(1), F.least(page, pages))


def total_estimate(start: Column, n: Column, size: int, most: int = 50_000) -> Column:
    """A lower bound of the rows there are."""
    return F.least(F.lit(most), start + n + F.when(n >= size, size).otherwise(0))


def opportunities(rows: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """P10: rows with key, impressions, clicks, ctr, position.  Give one page of a table for what the report shows, or the
    whole for all.  Ties are by key."""
    order = [F.desc("impressions"), F.asc("key")]
    return {
        "low_ctr": rows.where("impressions >= 50 and ctr < 0.02").orderBy(*order).limit(n),
        "near_top": rows.where("position >= 4 and position <= 10").orderBy(*order).limit(n),
        "second_page": rows.where("position > 10 and position <= 20").orderBy(*order).limit(n),
    }


def zero_filled(urls: DataFrame, performance: DataFrame, columns: list[str], key: str = "url") -> DataFrame:
    """J03."""
    return urls.join(performance, key, "left").fillna(0, columns)


def with_impressions(urls: DataFrame, performance: DataFrame, key: str = "url") -> DataFrame:
    """How many URLs have any."""
    seen = performance.where("impressions > 0").select(key)
    return urls.join(seen, key, "left_semi").agg(F.count("*").alias("urls_with_impressions"))


def inspected(urls: DataFrame, inspections: DataFrame, order: list[Column], n: int = 25, key: str = "url") -> DataFrame:
    """All URLs of a page, the first n with their inspection; where there is none, or it failed, a message tells so.
    The others are not asked for: their `available` and message are null."""
    first = urls.orderBy(*order).limit(n).select(F.col(key).alias("_asked"))
    asked = urls.join(F.broadcast(first), F.col(key) == F.col("_asked"), "left")
    seen = inspections.join(F.broadcast(first), F.col(key) == F.col("_asked"), "left_semi")
    out = asked.join(F.broadcast(seen), key, "left")
    there = F.col("_asked").isNotNull()
    message = F.when(there & F.col("verdict").isNull(), F.coalesce("message", F.lit("not inspected"))).when(there, F.col("message"))
    return out.withColumn("available", F.when(there, F.col("verdict").isNotNull())).withColumn("message", message).drop("_asked")


def top_distribution(rows: DataFrame, value: str, order: list[Column], n: int = 6) -> DataFrame:
    """The first rows with a positive value."""
    return rows.where(F.col(value) > 0).orderBy(*order).limit(n)


def share_of_total(rows: DataFrame, value: str, alias: str = "share") -> DataFrame:
    """A total in one aggregation and a one-row join, so rows stay in their partitions."""
    total = rows.agg(F.sum(value).alias("_total"))
    return rows.crossJoin(F.broadcast(total)).withColumn(alias, ratio(F.col(value), F.col("_total"))).drop("_total")


def scaled(rows: DataFrame, value: str) -> DataFrame:
    """The smallest and largest value beside each row."""
    ends = rows.agg(F.min(value).alias(f"min_{value}"), F.max(value).alias(f"max_{value}"))
    return rows.crossJoin(F.broadcast(ends))
