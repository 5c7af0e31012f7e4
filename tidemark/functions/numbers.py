"""Number expressions (M01-M06, T06, K-buckets): rounding, clamping, labels, changes and thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Anything as a double; what is not a finite number is 0."""
    n = c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), F.lit(0.0)).otherwise(n)


def round_half_up(c: Column) -> Column:
    """Halves go toward positive infinity, unlike `round`."""
    return F.floor(c + F.lit(0.5)).cast("long")


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    """M02; a null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def clamp_int(c: Column, fallback: int, low: int = 0, high: int = 100) -> Column:
    """A model's number as a whole number in bounds, or the fallback if it is not one."""
    n = c.try_cast("double")
    ok = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return F.coalesce(F.when(ok, F.greatest(F.lit(low), F.least(F.lit(high), round_half_up(n)))), F.lit(fallback)).cast("int")


def change(current: Column, previous: Column) -> Column:
    """Percent change; from nothing, 100 for something and 0 for nothing."""
    safe = F.when(previous == 0, F.lit(1.0)).otherwise(F.abs(previous))
    return F.when(previous == 0, F.when(current != 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise((current - previous) / safe * 100)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.when(whole == 0, F.lit(1)).otherwise(whole))


def bytes_label(c: Column) -> Column:
    """What is no number counts as 0."""
    n = number(c)
    return (
        F.when(n < 1024, F.concat(round_half_up(n).cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / (1024 * 1024)), F.lit(" MB")))
    )


def ms_label(c: Column) -> Column:
    """What is no number counts as 0."""
    n = number(c)
    return F.when(n >= 1000, F.concat(F.format_string("%.2f", n / 1000), F.lit(" s"))).otherwise(F.concat(round_half_up(n).cast("string"), F.lit(" ms")))


def grouped_label(c: Column, digits: int = 0) -> Column:
    """Thousands in groups, at most so many digits after the point, and no zeros at their end."""
    return F.call_function("format_number", F.round(number(c), digits), F.lit("#,##0" + ("." + "#" * digits if digits else "")))


def percent_label(c: Column, digits: int = 1) -> Column:
    """A share as a percentage."""
    return F.concat(grouped_label(number(c) * 100, digits), F.lit("%"))


def band_midpoint(c: Column) -> Column:
    """The mean of the two numbers of a band; 0 for what is not a band, such as "5K+"."""
    found = r"(\d+(?:\.\d+)?)\s*[–—-]\s*(\d+(?:\.\d+)?)"
    low, high = (F.regexp_extract(c, found, k).try_cast("double") for k in (1, 2))
    return F.coalesce((low + high) / 2, F.lit(0.0))


#: Up to which a metric is good, and up to which it needs improvement.
METRIC_LIMITS = [
    ("LCP", 2500.0, 4000.0),
    ("INP", 200.0, 500.0),
    ("CLS", 0.1, 0.25),
    ("FCP", 1800.0, 3000.0),
    ("TTFB", 800.0, 1800.0),
    ("TBT", 200.0, 600.0),
]


def metric_bucket(metric: Column, value: Column) -> Column:
    """Limits are inclusive; other metrics and nulls are unknown."""
    out = F.lit("unknown")
    for name, good, fair in METRIC_LIMITS:
        out = F.when((metric == name) & value.isNotNull(), F.when(value <= good, "good").when(value <= fair, "needs-improvement").otherwise("poor")).otherwise(out)
    return out


def score_bucket(score: Column) -> Column:
    """K10."""
    return F.when(score.isNull(), "unknown").when(score >= 90, "good").when(score >= 50, "needs-improvement").otherwise("poor")


def score_tile(score: Column) -> Column:
    """K16."""
    return F.when(score >= 80, "strong").when(score >= 50, "needs work").otherwise("priority")


def category_score(score: Column) -> Column:
    """A share as a whole percentage; null stays null."""
    return round_half_up(score * 100)


def diagnostic_status(score: Column) -> Column:
    """Null counts as needing improvement."""
    return F.when(score < 0.5, "poor").otherwise("needs-improvement")


def direction(value: Column, inverse: bool = False) -> Column:
    """Whether a change is up, down or flat; inverse for measures that should fall."""
    s = F.signum(value) * (-1 if inverse else 1)
    return F.when(s > 0, "up").when(s < 0, "down").otherwise("flat")


def age_label(years: Column) -> Column:
    """K17."""
    return F.when(years < 1, "<1 year").otherwise(F.concat(F.floor(years).cast("string"), F.lit(" years")))


def snap(c: Column, allowed: list[str], fallback: str) -> Column:
    """A value of an enumeration, whatever its case, or the fallback; hyphens stand for dashes in ranges."""
    out = F.lit(fallback)
    plain = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    dashed = F.replace(plain, F.lit("-"), F.lit("–"))
    for a in reversed(allowed):
        out = F.when((plain == a.lower()) | (dashed == a.lower()), F.lit(a)).otherwise(out)
    return out
