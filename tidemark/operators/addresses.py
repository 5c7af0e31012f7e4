"""Address ranges as a table (P05): the longest range that holds an address, for IPv4 and IPv6 alike.

An address is 32 hexadecimal digits, one of IPv4 behind the prefix by which IPv6 maps it.  A range of p bits is the first p of
them, so an interval join is one of equal keys: for each length that the ranges have (129 at most) the address's own prefix.
Each distinct address is looked up once and its label joined back; an address that most rows have is dealt to SALTS keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that an address is dealt to where its label is joined back.
SALTS = 16
#: Ranges that must not be fetched.
PRIVATE = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/3",
    "::/128", "::1/128", "fc00::/7", "fe80::/16",
]
_MAPPED = "0" * 20 + "ffff"


def bits(address: Column) -> Column:
    """The 32 digits of an address; null for what is none.  Brackets around it and a zone behind it are left out."""
    text = F.lower(F.regexp_replace(F.regexp_replace(F.trim(address), r"^\[(.*)\]$", "$1"), r"%.*$", ""))
    return F.transform(F.array(text), _digits)[0]


def _four(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))
    hexed = F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return F.when(F.rlike(text, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")) & F.forall(parts, lambda x: x <= 255), hexed)


def _digits(text: Column) -> Column:
    tail = F.regexp_extract(text, r":(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    four = _four(tail)
    plain = F.when(tail == "", text).when(four.isNotNull(), F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4)))
    halves = F.transform(F.split(plain, "::", -1), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1)))
    wide = lambda xs: F.array_join(F.transform(xs, lambda x: F.lpad(x, 4, "0")), "")

    def six(parts: Column) -> Column:
        first, second, n = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.array().cast("array<string>")), F.size(parts)
        count = F.size(first) + F.size(second)
        good = F.forall(F.concat(first, second), lambda x: F.rlike(x, F.lit("^[0-9a-f]{1,4}$"))) & (((n == 1) & (count == 8)) | ((n == 2) & (count <= 7)))
        return F.when(good, F.concat(wide(first), F.repeat(F.lit("0"), 32 - 4 * count), wide(second)))

    return F.when(text.contains(":"), F.transform(F.array(halves), six)[0]).otherwise(F.concat(F.lit(_MAPPED), _four(text)))


def prefix(digits: Column, n: Column) -> Column:
    """The first n bits of an address, as text: whole digits, and what is left of the next."""
    whole, rest = F.floor(n / 4).cast("int"), (n % 4).cast("int")
    cut = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int").bitwiseAND(F.when(rest == 1, 8).when(rest == 2, 12).otherwise(14))
    return F.concat(F.substring(digits, F.lit(1), whole), F.when(rest == 0, "").otherwise(F.lower(F.hex(cut))))


def table_of(ranges: DataFrame, column: str = "range") -> DataFrame:
    """Ranges (address/length, or a single address) with `_length` and `_key`; those that are none are left out."""
    cut = F.split(F.col(column), "/", 2)
    digits, n = bits(cut[0]), F.get(cut, F.lit(1))
    most = F.when(cut[0].contains(":"), 128).otherwise(32)
    length = F.when(F.size(cut) == 1, most).when(F.rlike(n, F.lit(r"^\d{1,3}$")) & (n.try_cast("int") <= most), n.try_cast("int")) + 128 - most
    out = ranges.withColumns({"_digits": digits, "_length": length}).where("_digits IS NOT NULL AND _length IS NOT NULL")
    return out.withColumn("_key", prefix(F.col("_digits"), F.col("_length"))).drop("_digits")


def held_by(rows: DataFrame, address: str, ranges: DataFrame, name: str = "range", column: str = "range") -> DataFrame:
    """Rows with the longest range that holds their address, null where none does, where the address is null or is none.
    Equal ranges written differently count as the smallest text."""
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")
    known = table_of(ranges, column).groupBy("_length", "_key").agg(F.min(column).alias("_range"))
    lengths = sorted(r["_length"] for r in known.select("_length").distinct().collect())
    found = rows.select(F.col(address).alias("_a")).distinct().withColumn("_digits", bits(F.col("_a"))).where("_digits IS NOT NULL")
    tried = found.select("_a", F.explode(F.lit(lengths) if lengths else F.array().cast("array<int>")).alias("_length"), "_digits")
    tried = tried.select("_a", "_length", prefix(F.col("_digits"), F.col("_length")).alias("_key"))
    best = tried.join(known, ["_length", "_key"]).groupBy("_a").agg(F.max_by("_range", "_length").alias("_range"))
    dealt = best.select("_a", "_range", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.col(address).alias("_b"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_r"))
    return whole.join(dealt, (F.col("_a") == F.col("_b")) & (F.col("_s") == F.col("_r")), "left").select("_row.*", F.col("_range").alias(name))


def private_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in PRIVATE], "range string")
