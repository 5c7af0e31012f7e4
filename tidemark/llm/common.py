"""What the training-data operators share: scratch tables, row keys, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What stands between two words; its complement, after A-Z are lower-cased, is [^\x00-\x2F\x3A-\x60\x7B-\x7F].
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("the session names no shared folder: set spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Written intermediate tables.  A table cuts the lineage and survives lost executors; `drop` frees it early."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.paths = spark, f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can; Python's processes outlive their tasks."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that name a row: rows that agree in id and text are one document to every operator."""
    return [F.col(doc_id).alias("_d"), F.xxhash64(F.col(text)).alias("_t")]


def whole_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs as one column, _row, and their keys, so that no column of theirs clashes with another."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key())


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["_d"].eqNullSafe(b["_d"]) & (a["_t"] == b["_t"])


def one_of_each(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One of the rows of each key (_d, _t), and the keys that several rows have: (d, t, n).  Only rows of these are shuffled."""
    several = texts.groupBy(F.col("_d").alias("d"), F.col("_t").alias("t")).agg(F.count("*").alias("n")).where("n > 1")
    several = scratch.keep(several, "several")
    same = texts["_d"].eqNullSafe(several["d"]) & (texts["_t"] == several["t"])
    return texts.join(several, same, "left_anti").union(texts.join(several, same, "left_semi").dropDuplicates(["_d", "_t"])), several


def raw_words(text: Column) -> Column:
    """The words of a text in order, with case kept; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS, -1), "")


def lower_az(word: Column) -> Column:
    """A-Z lower-cased and nothing else; `lower` does just that to a word of ASCII, and is much faster."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def smallest(df: DataFrame, h: Column, n: int) -> DataFrame:
    """The n rows of smallest hash (all, if fewer).  Of many rows only about twice as many are ordered, whatever the table's size."""
    total = df.count()
    df = df.withColumn("_h", F.shiftrightunsigned(h, 1))
    if total > 4 * n:
        df = df.where(F.col("_h") < int(2 * n / total * 2.0**63))
    return df.orderBy("_h", *df.columns).limit(n).drop("_h")


def bucket(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, by which the folds are fixed; null without an id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
