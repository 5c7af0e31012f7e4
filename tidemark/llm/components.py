"""Connected components of a table of links, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, label) for every node of `links` (a, b: long), where label is the same for a component and one of its nodes.

    In each round every node takes the smallest node among itself and its neighbours, links are renamed accordingly,
    and those within one node vanish.  Minima are taken map-side first, and the two joins are on a key that is unique on
    one side, so a node with very many links is split like any skewed join.  Loops and repeated links are allowed.
    """
    left = scratch.keep(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-0")
    known = scratch.keep(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("label", F.col("node")), f"{tag}-known-0")
    k = 0
    while left.limit(1).count():
        k += 1
        both = left.union(left.select("b", "a"))
        least = scratch.keep(both.groupBy(F.col("a").alias("old")).agg(F.min("b").alias("m")).select("old", F.least("old", "m").alias("new")), f"{tag}-min-{k}")
        x = left.join(least, left["a"] == least["old"]).select(F.col("new").alias("a"), "b")
        x = x.join(least, x["b"] == least["old"]).select("a", F.col("new").alias("b"))
        left = scratch.keep(x.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-{k}")
        known = scratch.keep(known.join(least, known["label"] == least["old"], "left").select("node", F.coalesce("new", "label").alias("label")), f"{tag}-known-{k}")
        scratch.drop(f"{tag}-min-{k}", f"{tag}-{k - 1}", f"{tag}-known-{k - 1}")
    return known
