"""Link summaries that grow batch by batch (A07, A12): a state in the shared folder, merged with each batch and never rebuilt.

For every batch the state holds two tables: the rows that won their (source, target, anchor) in it, over what was there before,
and by how much that changed the counts of each source domain.  A summary adds up the changes, so it reads one row for each
domain and batch and no links.  A batch that comes again is written over itself from the batches before it, and changes
nothing.  Batches have rising numbers, as those of a stream; one writer at a time.  The opt-in estimate of linking domains is
a sketch for each batch; domains that a later batch turned unverified stay in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.links import dedupe, live, summary_of_domains

KEY = ["source_url", "target_url", "anchor"]
_LINKS = "source_url string, source_domain string, target_url string, anchor string, rel string, follow boolean, live boolean, no_link_found boolean, http_status int"
_DOMAINS = "source_domain string, n long, l long, f long"
#: Columns of a link besides its key.
_REST = [c.split()[0] for c in _LINKS.split(", ") if c.split()[0] not in KEY]


class LinkState:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _before(self, kind: str, schema: str, batch: int | None) -> DataFrame:
        """What the batches before one wrote, or all; nothing if there is no state yet."""
        try:
            found = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], f"{schema}, batch long")
        return found if batch is None else found.where(F.col("batch") < batch)

    def links(self, batch: int | None = None) -> DataFrame:
        """The rows that stand, over all batches or those before one."""
        return self._before("links", _LINKS, batch).groupBy(*KEY).agg(F.max_by(F.struct(*_REST), "batch").alias("x")).select(*KEY, "x.*")

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Adds the rows of a batch: links with the columns of `links.verify`; columns that are not of a link are left out."""
        own = self.spark.createDataFrame([], _LINKS).unionByName(rows.drop(*[c for c in rows.columns if c not in [*KEY, *_REST]]), allowMissingColumns=True)
        new = dedupe(own.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(_LINKS)]))
        # keys of the batch alone are looked up, null keys as well
        a = new.alias("a")
        same = F.lit(True)
        for k in KEY:
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        there = self.links(batch).withColumn("_there", F.lit(True)).alias("b")
        both = a.join(there, same, "left").select(F.struct("a.*").alias("a"), F.when(F.col("b._there"), F.struct(*[f"b.{c}" for c in [*KEY, *_REST]])).alias("b"))
        won = both.where(F.col("b").isNull() | _better(F.col("a"), F.col("b")))
        target = f"{self.path}/links/batch={batch}"
        won.select("a.*", F.col("b").alias("_old")).write.mode("overwrite").parquet(target)
        written = self.spark.read.schema(StructType.fromDDL(_LINKS).add("_old", StructType.fromDDL(_LINKS))).parquet(target)
        gained = _counts(written.select(*KEY, *_REST), 1)
        lost = _counts(written.where("_old IS NOT NULL").select("_old.*"), -1)
        change = gained.unionByName(lost).groupBy("source_domain").agg(*[F.sum(c).alias(c) for c in "nlf"]).where("n <> 0 OR l <> 0 OR f <> 0")
        change.write.mode("overwrite").parquet(f"{self.path}/domains/batch={batch}")
        sketch = written.where(live(F.col("live"), F.col("no_link_found"))).agg(F.hll_sketch_agg("source_domain").alias("sketch"))
        sketch.write.mode("overwrite").parquet(f"{self.path}/sketches/batch={batch}")

    def domains(self) -> DataFrame:
        """Counts of links, live ones and live ones to follow, by source domain."""
        added = self._before("domains", _DOMAINS, None).groupBy("source_domain").agg(*[F.sum(c).alias(c) for c in "nlf"])
        return added.where("n > 0")

    def summary(self) -> DataFrame:
        """The exact summary, as `links.summary` has it over all rows at once."""
        return summary_of_domains(self.domains())

    def domains_estimate(self) -> DataFrame:
        """About how many domains link, from the batches' sketches."""
        return self._before("sketches", "sketch binary", None).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0).cast("long")).alias("domains"))

    def each_batch(self) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch."""
        return lambda rows, batch: self.merge(rows, batch)


def _counts(rows: DataFrame, sign: int) -> DataFrame:
    is_live = live(F.col("live"), F.col("no_link_found"))
    counts = rows.groupBy("source_domain").agg(F.count("*").alias("n"), F.count_if(is_live).alias("l"), F.count_if(is_live & F.col("follow")).alias("f"))
    return counts.select("source_domain", *[(sign * F.col(c)).alias(c) for c in "nlf"])


def _better(a: Column, b: Column) -> Column:
    """Whether a link comes before another of its key in the order of `links.dedupe`: live first, then the smaller status, those
    without one last, then the smaller rel."""
    rank = lambda x: F.struct(
        F.when(x["live"].isNull(), 2).when(x["live"], 0).otherwise(1),
        x["http_status"].isNull(), F.coalesce(x["http_status"], F.lit(0)), x["rel"].isNotNull(), F.coalesce(x["rel"], F.lit("")),
    )
    return rank(a) < rank(b)
