"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Equal vectors are kept once, with the smallest ids that a result can need.  Vectors are dealt by hash to shards, as many
as there are cores but of SHARD rows and SHARD_BYTES at most, about; each shard's graph is built in one task and kept as flat
neighbour arrays in one row of a written table.  A node of a graph is a direction: vectors that differ in length alone share it,
and a search that meets it scores them all, so that ties are whole however many there are.  All queries are sent to each shard, whose task reads the graph and then lets the queries pass by;
nothing of either is collected.  A search in a graph grows with the logarithm of its rows.  Each shard returns its
nearest, with cosines in double precision of the original vectors, and these are merged by score, then smaller id.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without id.  Vectors of
other lengths than the query are never near.  Rows that agree in id and vector are one; an id with several vectors counts
with the nearest.  An id that is no whole number is an error.  Fewer candidates than k: all of them.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.ngram_join import _grouped

#: Rows of a shard at most, about, and rows below which no more shards are made for more cores.
SHARD, LEAST_ROWS = 100_000, 4096
#: Bytes of a shard's vectors at most, about.
SHARD_BYTES = 64_000_000
LINKS, BUILD, SEARCH = 16, 64, 96


class Graph:
    """Unit vectors, and per layer an array of neighbours with as many columns as a node may have."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray] | None = None, degrees: list[np.ndarray] | None = None, entry: int = 0):
        self.unit, self.entry = unit, entry
        self.layers, self.degrees = layers or [], degrees or []
        self.seen, self.stamp = np.zeros(len(unit), np.int32), 0

    @staticmethod
    def build(unit: np.ndarray, links: int = LINKS, width: int = BUILD) -> Graph:
        g, n = Graph(unit), len(unit)
        level = np.minimum((-np.log(1 - np.random.default_rng(16).random(n)) / np.log(links)).astype(int), 8)
        level[0] = level.max(initial=0)
        g.layers = [np.full((n, links * (2 if k == 0 else 1)), -1, np.int32) for k in range(level.max(initial=0) + 1)]
        g.degrees = [np.zeros(n, np.int32) for _ in g.layers]
        for i in range(1, n):
            q, near = unit[i], [(float(unit[0] @ unit[i]), 0)]
            for k in range(len(g.layers) - 1, -1, -1):
                if k > level[i]:
                    near = g._search(q, near, 1, k)
                    continue
                near = g._search(q, near, width, k)
                chosen = g._spread(near, links)
                g.layers[k][i, : len(chosen)], g.degrees[k][i] = chosen, len(chosen)
                for c in chosen:
                    g._link(k, c, i)
        return g

    def _link(self, k: int, c: int, i: int) -> None:
        table, degree = self.layers[k], self.degrees[k]
        d = degree[c]
        if d < table.shape[1]:
            table[c, d], degree[c] = i, d + 1
            return
        all_of = np.append(table[c], i)
        s = self.unit[all_of] @ self.unit[c]
        kept = self._spread(list(zip(s.tolist(), all_of.tolist(), strict=True)), table.shape[1])
        table[c, : len(kept)], degree[c] = kept, len(kept)

    def _spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Near nodes that are closer to the centre than to those before them; then the nearest of the others."""
        near = sorted(near, reverse=True)
        if len(near) <= most:
            return [x for _, x in near]
        ids = np.array([x for _, x in near])
        among = self.unit[ids] @ self.unit[ids].T
        kept: list[int] = []
        closest = np.full(len(ids), -2.0, among.dtype)
        for k, (s, _) in enumerate(near):
            if closest[k] < s:
                kept.append(k)
                if len(kept) == most:
                    break
                np.maximum(closest, among[k], out=closest)
        rest = sorted(set(range(len(ids))).difference(kept))
        kept += rest[: most - len(kept)]
        return ids[kept].tolist()

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], width: int, k: int) -> list[tuple[float, int]]:
        table, degree, unit, seen = self.layers[k], self.degrees[k], self.unit, self.seen
        self.stamp += 1
        stamp = self.stamp
        found = list(start)
        heapify(found)
        ahead = [(-s, x) for s, x in start]
        heapify(ahead)
        for _, x in start:
            seen[x] = stamp
        while len(found) > width:
            heappop(found)
        while ahead:
            s, c = heappop(ahead)
            if -s < found[0][0] and len(found) >= width:
                break
            around = table[c, : degree[c]]
            around = around[seen[around] != stamp]
            if not len(around):
                continue
            seen[around] = stamp
            for t, x in zip((unit[around] @ q).tolist(), around.tolist(), strict=True):
                if len(found) < width:
                    heappush(found, (t, x))
                elif t > found[0][0]:
                    heapreplace(found, (t, x))
                else:
                    continue
                heappush(ahead, (-t, x))
        return found

    def nearest(self, q: np.ndarray, width: int = SEARCH) -> list[int]:
        near = [(float(self.unit[self.entry] @ q), self.entry)]
        for k in range(len(self.layers) - 1, 0, -1):
            near = self._search(q, near, 1, k)
        return [x for _, x in self._search(q, near, width, 0)] if self.layers else [self.entry]


def usable(embedding: Column) -> Column:
    """The vector in double precision, or null if it takes no part."""
    v = embedding.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda n, x: n + x * x)
    return F.when(finite & (square > 0) & (square < float("inf")), v)


_INDEX = "shard int, dim int, kind int, vec_id long, v binary, ids binary, counts binary, vectors binary, nodes binary, layers array<binary>, degrees array<binary>"
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector its direction's number, and the directions: unit vectors in single precision, each once."""
    unit = np.ascontiguousarray((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32) + np.float32(0))  # no negative zeros
    _, first, nodes = np.unique(unit.view(np.dtype((np.void, unit.itemsize * unit.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return nodes, unit[first]


def _build(batches):
    for (shard, dim), parts in _grouped(batches, 2):
        t = pa.Table.from_batches(parts)
        lists = [sorted(x) for x in t.column("ids").to_pylist()]
        vectors = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in t.column("v").chunks]).reshape(len(lists), -1)
        nodes, unit = directions(vectors)
        first = np.full(len(unit), np.iinfo(np.int64).max)  # of each node, the smallest id: graphs don't depend on the order of rows
        np.minimum.at(first, nodes, [x[0] for x in lists])
        rank = np.empty(len(unit), np.int64)
        rank[np.argsort(first, kind="stable")] = np.arange(len(unit))
        order = sorted(range(len(lists)), key=lambda k: (rank[nodes[k]], lists[k]))
        vectors, lists, nodes = vectors[order], [lists[k] for k in order], rank[nodes][order]
        g = Graph.build(unit[np.argsort(rank)])
        ids = np.concatenate([np.array(x, np.int64) for x in lists])
        counts = np.array([len(x) for x in lists], np.int32)
        row = [int(shard), int(dim), 0, None, None, ids.tobytes(), counts.tobytes(), vectors.tobytes(), nodes.astype(np.int32).tobytes(), [x.tobytes() for x in g.layers], [x.tobytes() for x in g.degrees]]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS, strict=True)], names=_NAMES)


class Shard:
    """A shard's graph, read from its row."""

    def __init__(self, row: dict):
        self.key = row["shard"], row["dim"]
        self.counts, self.ids = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["ids"], np.int64)
        self.ends, n = np.cumsum(self.counts), len(self.counts)
        self.vectors = np.frombuffer(row["vectors"]).reshape(n, -1)
        self.norms = np.linalg.norm(self.vectors, axis=1)
        nodes = np.frombuffer(row["nodes"], np.int32)  # in order
        self.begin = np.searchsorted(nodes, np.arange(nodes[-1] + 2))
        layers = [np.frombuffer(x, np.int32).reshape(len(self.begin) - 1, -1) for x in row["layers"]]
        one = self.begin[:-1]
        self.graph = Graph((self.vectors[one] / self.norms[one, None]).astype(np.float32), layers, [np.frombuffer(x, np.int32) for x in row["degrees"]])

    def nearest(self, me: int, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        size = np.linalg.norm(q)
        met = np.array(self.graph.nearest((q / size).astype(np.float32), max(SEARCH, 2 * k)))
        near = np.concatenate([np.arange(self.begin[x], self.begin[x + 1]) for x in met.tolist()])
        s = (self.vectors[near] * q).sum(1) / (self.norms[near] * size)
        order = np.argsort(-s, kind="stable")
        near, s = near[order], s[order]
        # all that are no farther than the one with which k others are there for sure
        least = s[min(int(np.searchsorted(np.cumsum(self.counts[near]), k + 1)), len(s) - 1)]
        best = [(-a, y) for x, a in zip(near.tolist(), s.tolist(), strict=True) if a >= least for y in self.ids[self.ends[x] - self.counts[x] : self.ends[x]].tolist() if y != me]
        return [(me, y, -a) for a, y in sorted(best)[:k]]


def _searcher(k: int):
    def run(batches):
        """Rows sorted by shard, dim and kind: a shard's graph, then all queries, which pass by one at a time."""
        shard = None
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            kinds = batch.column(2).to_pylist()
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            asked, vectors = batch.column(3).to_pylist(), batch.column(4)
            for at, kind in enumerate(kinds):
                if kind == 0:
                    shard = None  # freed before the next is read
                    shard = Shard(batch.slice(at, 1).to_pylist()[0])
                elif shard is not None and shard.key == keys[at]:  # without a graph, no vector of this length is in the shard
                    out += shard.nearest(asked[at], np.frombuffer(vectors[at].as_buffer()), k)
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _packed(batches):
    """Vectors as bytes."""
    for batch in batches:
        v = [np.array(x.as_py(), float).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 8 for x in v], pa.int32()), pa.array(v, pa.binary())], names=["vec_id", "dim", "v"])


def build_index(rows: DataFrame, k: int, scratch: Scratch, shard_rows: int = SHARD) -> tuple[DataFrame, int]:
    """A row for each shard, and the number of shards.  rows: vec_id, v."""
    keyed = rows.select("vec_id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(3), "v").alias("h2")).dropDuplicates(["h1", "h2", "vec_id"])
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = scratch.keep(first.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.first("dim").alias("dim"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
    size = distinct.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n = size["n"]
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // (8 * (size["dim"] or 1))))
    # as many shards as cores while shards stay small, then as few as a task's memory allows, as each query visits them all
    shards = max(1, -(-n // shard_rows), min(-(-n // LEAST_ROWS), rows.sparkSession.sparkContext.defaultParallelism))
    dealt = distinct.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "dim", "ids", "v").repartition(shards, "shard").sortWithinPartitions("shard", "dim")
    index = scratch.keep(dealt.mapInArrow(_build, _INDEX), "index")
    scratch.drop("distinct")
    return index, shards


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score.  Both tables have vec_id and embedding."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ann")
    of = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    index, shards = build_index(of(embeddings), k, scratch, shard_rows)
    asked = of(queries).distinct().mapInArrow(_packed, "vec_id long, dim int, v binary")
    nothing = [F.lit(None).cast(x.split(" ")[1]).alias(x.split(" ")[0]) for x in _INDEX.split(", ")[5:]]
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(1).alias("kind"), "vec_id", "v", *nothing)
    dealt = index.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind")
    found = dealt.mapInArrow(_searcher(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
