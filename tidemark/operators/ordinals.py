"""Places of all rows in an order (W02, L04): range partitions, their counts, and the sums of the counts before each.

No window sees more than a partition, and no task more than its range.  The rows are written once, by partition, so that a page
reads only the partitions that hold it; ranges are drawn from a sample, so they must not be drawn again.  Rows that tie in the
order are told apart by a hash of the whole row; copies of one row stay together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.periods import DEFAULT_PAGE, PAGE_SIZES
from tidemark.sources.kept import shared_folder

#: monotonically_increasing_id counts the rows of a partition in its lowest 33 bits.
_ROWS = (1 << 33) - 1


@dataclass(frozen=True)
class Numbered:
    """A written table with a place for each row, and what is needed to read a part of it."""

    spark: SparkSession
    path: str
    #: of what is written: the row as one column, its partition, its place there
    schema: StructType

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def offsets(self) -> DataFrame:
        """part, n and the number of rows before it; one row for each partition.  The sums are within one array, as long as
        the table has partitions."""
        return self.spark.read.parquet(f"{self.path}/offsets")

    def total(self) -> int:
        return self.offsets().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def rows(self, name: str = "ordinal") -> DataFrame:
        """All rows with their place, from 1."""
        offsets = self.offsets().select(F.col("part").alias("_part"), "before")
        placed = self._rows().join(F.broadcast(offsets), "_part")
        return placed.select(F.col("_row.*"), (F.col("before") + F.col("_n") + 1).alias(name))

    def between(self, first: int, last: int, name: str = "ordinal") -> DataFrame:
        """Rows of places first to last, in order; partitions that hold none of them are not read."""
        parts = self.offsets().where((F.col("before") < last) & (F.col("before") + F.col("n") >= first)).select("part", "before").collect()
        if not parts:
            return self.rows(name).limit(0)
        before = F.lit(None).cast("long")
        for part, n in sorted(parts):
            before = F.when(F.col("_part") == part, F.lit(n)).otherwise(before)
        kept = self._rows().where(F.col("_part").isin([p for p, _ in parts])).withColumn(name, before + F.col("_n") + 1)
        return kept.where(F.col(name).between(first, last)).select("_row.*", name).orderBy(name)

    def page(self, page: int = 1, size: int = DEFAULT_PAGE, name: str = "ordinal") -> DataFrame:
        """A page; sizes that are not offered count as the usual one, pages before the first as the first."""
        size = size if size in PAGE_SIZES else DEFAULT_PAGE
        start = (max(1, page) - 1) * size
        return self.between(start + 1, start + size, name)


def numbered(rows: DataFrame, order: list[Column | str], parts: int | None = None) -> Numbered:
    """Writes rows by range partitions in the folder that the session names.  parts: how many, else what the session plans.

    Nulls sort as the order says.  A table without rows has no places.  No column name clashes, as rows are one struct."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/ordinals-{uuid.uuid4().hex}"
    if not rows.columns:
        raise ValueError("rows have no column")
    plain = [f.name for f in rows.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0)
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    by = [*order, tie.asc()]
    ranged = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    placed = ranged.sortWithinPartitions(*by).select(row.alias("_row"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS)).alias("_n"))
    placed.write.partitionBy("_part").parquet(f"{path}/rows")
    out = Numbered(spark, path, placed.schema)
    counts = out._rows().groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n"))
    listed = counts.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("x"))
    sums = F.aggregate("x", F.expr("named_struct('before', 0L, 'out', cast(array() AS array<struct<part: int, n: bigint, before: bigint>>))"), lambda a, p: F.struct((a["before"] + p["n"]).alias("before"), F.concat(a["out"], F.array(F.struct(p["part"].alias("part"), p["n"].alias("n"), a["before"].alias("before")))).alias("out")), lambda a: a["out"])
    listed.select(F.explode(sums).alias("x")).select("x.*").write.parquet(f"{path}/offsets")
    return out
