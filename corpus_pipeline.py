"""A corpus pipeline of training-data operators: good documents, without repeated lines, near copies or benchmark text, as ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import Scratch, table, whole_rows
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.ngram_join import one_of_each_group
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import ranks

#: One stage cannot be expressed in SQL (a trained classifier), so there is no SQL for the whole.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of later copies; those of which nothing is left go, those that came empty stay.

    Columns named like an output of line_dedup pass through like any other."""
    own = {c: f"__{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    docs = docs.withColumnsRenamed(own)
    deduped = line_dedup(docs)
    n_chars = {"n_chars": F.length("text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {}
    kept = deduped.where((F.col("n_removed") == 0) | (F.length("text") > 0))
    changed = {c: F.when(F.col("n_removed") > 0, x).otherwise(F.col(c)) for c, x in n_chars.items()}
    return kept.withColumns(changed).select(*docs.columns).withColumnsRenamed({new: c for c, new in own.items()})


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each_group(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    dirty = decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), near=None).where("contaminated").select(F.col("doc_id").alias("_xd"), F.col("_t").alias("_xt")).distinct()
    keyed = whole_rows(docs)
    return keyed.join(dirty, keyed["_d"].eqNullSafe(dirty["_xd"]) & (keyed["_t"] == dirty["_xt"]), "left_anti").select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, their number, and digests of the ids and of the bytes they decode to; other columns go."""
    return bpe.encode(docs.select("doc_id", "text"), ranks(), public_tokenizers.PATTERN, digests=True, drop=True)


STAGES = [("quality", quality), ("line_dedup", lines), ("ngram_join", near_copies), ("decontaminate", clean), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
