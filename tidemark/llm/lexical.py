"""Ranked lexical search with a two-level quantised index.

A term of a query adds w * r to a document's score: w is the term's weight, r = (10^9 tf) div (1000 tf + 20 m) below 10^6 the
impact of its tf occurrences, and m the document's length against the mean.  All but w's logarithm is in whole numbers.

1. Level two of the index: for every document the numbers of the queries' terms that it has, and how often, with its length.
   Texts are split and counted in tasks; only this is written.  N, L and df are sums over it.
2. Level one: a byte for each posting, the impact in units of UNIT, rounded up.  So a document's score is at most
   UNIT * sum(w * byte), and at least UNIT * sum(w * (byte - 1)).
3. Bounds of all documents for all queries of a block are one product of a matrix of bytes and one of weights, in pieces of
   bounded size.  A task keeps each query's k best lower bounds; merged over salted groups, they give the kth lower bound over
   all documents.
4. Every document whose upper bound reaches it is scored anew from level two, in whole numbers.  A task keeps its k best a
   query, which are merged alike.  Nothing that can be in a result is left out: a document of the k best has an upper bound of
   at least its score, which is at least the kth lower bound.

Queries come in blocks of at most QUERIES, with at most TERMS different terms (a longer one alone); a block is what is broadcast, and each block is
one pass over the texts.  A hot term, document or query is no hot key: the texts are not shuffled, and of each task k rows a
query are.

Null texts have no terms, and so do texts without a letter, digit or character beyond ASCII: they are not counted in N, and
found by no query.  Texts of any length are read whole.  Terms of a query count once.  Rows of equal doc_id are documents of
their own, in any order among equal scores; a null doc_id comes after all others.  Items of equal id are queries of their own;
items without a term have no rows.  Empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch
from tidemark.llm.fim import _flat, _stretches

K = 50
#: Impacts below MOST are rounded up to whole numbers of UNIT, at most 255.
MOST = 1_000_000
UNIT = -(-MOST // 255)
#: Different terms and queries in a block; cells of a matrix of bounds or impacts; bytes of text that are split at once; groups that merge a query's rows first.
TERMS, QUERIES, CELLS, AT_ONCE, SALTS = 4_096, 1_024, 4_000_000, 4_000_000, 64

#: A byte of text to what a term has of it: separators of ASCII become blanks, A-Z become a-z.
FOLD = bytes(32 if x < 0x30 or 0x3A <= x <= 0x40 or 0x5B <= x <= 0x60 or 0x7B <= x <= 0x7F else x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))
NO_ID = np.iinfo(np.int64).max

POSTINGS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tids", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
BYTES = T.StructType([*POSTINGS, T.StructField("impacts", T.BinaryType())])
FOUND = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def _lists(values: list[int], lengths: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values, pa.int32()))


def _posted(batches, terms) -> Iterator[pa.RecordBatch]:
    """Level two: the postings of the terms, and the length, of each document."""
    known = terms.value
    for batch in batches:
        raw, offsets = _flat(batch.column(1))
        for first, last in _stretches(offsets, AT_ONCE):
            folded = raw[offsets[first] : offsets[last]].tobytes().translate(FOLD)
            places = (offsets[first : last + 1] - offsets[first]).tolist()
            n, lengths, tids, tfs = [], [], [], []
            for a, b in zip(places, places[1:], strict=False):
                words = folded[a:b].split()
                counts = Counter(words)
                mine = known.keys() & counts.keys()
                n.append(len(words))
                lengths.append(len(mine))
                tids.extend(map(known.__getitem__, mine))
                tfs.extend(map(counts.__getitem__, mine))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), _lists(tids, lengths), _lists(tfs, lengths)], names=POSTINGS.names)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """r of each posting, from the length n of its document."""
    each, where = np.unique(n, return_inverse=True)
    m = np.array([50 + 50 * x * docs // total for x in each.tolist()], np.int64)[where]
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lengths, and of all postings their row, term and number."""
    lists = batch.column("tids")
    count = np.diff(np.asarray(lists.offsets))
    return batch.column("n").to_numpy(), np.repeat(np.arange(len(count)), count), lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()


def _quantised(batches, docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """Level one: the impacts in units, rounded up to a byte."""
    for batch in batches:
        n, row, _, tf = _columns(batch)
        r = impacts(tf, n[row], docs, total) if len(row) else np.empty(0, np.int64)
        held = (-(-r // UNIT)).astype(np.uint8)
        ends = np.cumsum(np.bincount(row, minlength=len(n)))
        offsets = np.r_[0, ends].astype(np.int32)
        made = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
        yield pa.RecordBatch.from_arrays([*batch.columns, made], names=BYTES.names)


def _bounds(batch: pa.RecordBatch, weights: np.ndarray, both: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """For runs of rows, from a first one on: upper and, if both are wanted, lower bounds in units of each row and query;
    weights has a row a term."""
    terms, queries = weights.shape
    step = max(1, CELLS // max(terms, queries, 1))
    for first in range(0, batch.num_rows, step):
        part = batch.slice(first, step)
        _, row, tid, _ = _columns(part)
        held = _flat(part.column("impacts"))[0]
        cells = np.zeros((part.num_rows, terms))
        cells[row, tid] = held
        upper = cells @ weights
        if both:
            cells[row, tid] = np.maximum(held, 1) - 1.0
        yield first, upper, cells @ weights if both else None


def _k_best(rows: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k of largest value, ties to the smaller second."""
    value, second = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((second, -value))[:k]
    return value[order], second[order]


class _Kept:
    """The k best (value, second) of each query; merged now and then, so that memory is bounded."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, [[] for _ in range(queries)]
        self.floor = np.full(queries, -1.0)

    def add(self, q: int, value: np.ndarray, second: np.ndarray) -> None:
        held = self.held[q]
        held.append((value, second))
        if sum(len(x) for x, _ in held) >= 4 * self.k:
            best = _k_best(held, self.k)
            self.held[q] = [best]
            self.floor[q] = best[0][-1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = [(q, *_k_best(x, self.k)) for q, x in enumerate(self.held) if x]
        if not best:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.repeat([q for q, _, _ in best], [len(x) for _, x, _ in best]).astype(np.int32), np.concatenate([y for _, _, y in best]), np.concatenate([x for _, x, _ in best])


def _sent(kept: _Kept) -> Iterator[pa.RecordBatch]:
    q, doc, value = kept.rows()
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(doc.astype(np.int64), mask=doc == NO_ID), pa.array(value.astype(np.int64))], names=FOUND.names)


def _lowest(batches, block, k: int) -> Iterator[pa.RecordBatch]:
    """The k best lower bounds of each query among a task's documents."""
    weights, task = block.value, TaskContext.get().partitionId()
    kept = _Kept(weights.shape[1], k)
    for batch in batches:
        for _, upper, lower in _bounds(batch, weights, True):
            for q in np.flatnonzero(((upper > 0) & (lower > kept.floor)).any(0)).tolist():
                there = lower[(upper[:, q] > 0) & (lower[:, q] > kept.floor[q]), q]
                there = np.partition(there, -k)[-k:] if len(there) > k else there
                kept.add(q, there, np.full(len(there), task))
    yield from _sent(kept)


def _rescored(batches, block, floors, docs: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best exact scores of each query among a task's documents whose upper bound reaches the floor."""
    weights, floor = block.value, floors.value
    exact = weights.astype(np.int64)
    kept = _Kept(weights.shape[1], k)
    for batch in batches:
        n, _, _, _ = _columns(batch)
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
        lists = batch.column("tids")
        offsets, tids, tfs = np.asarray(lists.offsets) - lists.offsets[0].as_py(), lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
        for first, upper, _ in _bounds(batch, weights, False):
            row, query = np.nonzero((upper >= floor) & (upper > 0))
            for some in np.array_split(np.arange(len(row)), max(1, -(-len(row) // 20_000))) if len(row) else ():
                rows, queries = row[some] + first, query[some]
                count = offsets[rows + 1] - offsets[rows]
                pair = np.repeat(np.arange(len(some)), count)
                at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[rows], count)
                w = exact[tids[at], queries[pair]]
                counted = np.flatnonzero(w)
                pair, at, w = pair[counted], at[counted], w[counted]
                if not len(at):
                    continue
                scores = np.zeros(len(some), np.int64)
                np.add.at(scores, pair, w * impacts(tfs[at], n[rows[pair]], docs, total))
                order = np.argsort(queries, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(queries[order])) + 1):
                    mine = mine[scores[mine] > 0]
                    if len(mine):
                        kept.add(int(queries[mine[0]]), scores[mine], ids[rows[mine]])
    yield from _sent(kept)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """rows (q, doc_id, score) with rank: each query's k best; groups of a part of its rows come first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    some = rows.withColumn("rank", F.row_number().over(W.partitionBy("q", "salt").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "salt")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def _blocks(queries: Iterable[tuple[int, list[bytes]]]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Queries in blocks of at most QUERIES and TERMS different terms; one with more is alone."""
    block, terms = [], set()
    for q, mine in queries:
        if block and (len(block) == QUERIES or len(terms | set(mine)) > TERMS):
            yield block
            block, terms = [], set()
        block.append((q, mine))
        terms |= set(mine)
    if block:
        yield block


def _searched(docs: DataFrame, block: list[tuple[int, list[bytes]]], k: int, scratch: Scratch, tag: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    terms = {term: i for i, term in enumerate(sorted({term for _, mine in block for term in mine}))}
    known = context.broadcast(terms)
    postings = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_posted, terms=known), POSTINGS), f"postings-{tag}")
    size = postings.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    number, total = size["docs"], size["total"] or 1
    df = {r["tid"]: r["df"] for r in postings.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count("*").alias("df")).collect()}  # at most one row a term of the block
    weights = np.zeros((len(terms), len(block)))
    for j, (_, mine) in enumerate(block):
        for i in map(terms.__getitem__, mine):
            weights[i, j] = math.floor(1000 * math.log((2 * number + 2) / (2 * df.get(i, 0) + 1)))
    held = context.broadcast(weights)
    index = scratch.keep(postings.where(F.size("tids") > 0).mapInArrow(partial(_quantised, docs=number, total=total), BYTES), f"index-{tag}")
    scratch.drop(f"postings-{tag}")
    lowest = index.mapInArrow(partial(_lowest, block=held, k=k), FOUND)
    kth = np.zeros(len(block))
    for r in _best(lowest, k).where(F.col("rank") == k).select("q", "score").collect():  # one row a query of the block
        kth[r["q"]] = r["score"]
    floors = context.broadcast(kth)
    best = _best(index.mapInArrow(partial(_rescored, block=held, floors=floors, docs=number, total=total, k=k), FOUND), k)
    names = docs.sparkSession.createDataFrame([(j, q) for j, (q, _) in enumerate(block)], "j int, query long")
    return best.join(names, best["q"] == names["j"]).select("query", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text), the k documents (doc_id, text) of highest score above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    named = scratch.keep(items.select("item_id", "text").withColumn("query", F.monotonically_increasing_id()), "items")
    rows = ((r["query"], sorted(set(terms_of(r["text"])))) for r in named.where("text is not null").select("query", "text").toLocalIterator())
    found = []
    for b, block in enumerate(_blocks((q, mine) for q, mine in rows if mine)):
        found.append(scratch.keep(_searched(docs, block, k, scratch, str(b)), f"found-{b}"))
        scratch.drop(f"index-{b}")
    if not found:
        return named.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionAll, found).join(named.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
