"""Intermediate tables that cut the lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local one only on a local master."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("the session names no shared folder: set spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that the session names; a local one only on a local master."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
