"""N-gram Jaccard self-join by chosen paths.

Texts become sets of hashed five-word shingles.  Equal sets are one class with one representative; everything below
works on representatives, so copies cost nothing more.

Chosen paths: a set is embedded as COORDINATES MinHash values, the tokens of a set of fixed size.  In each of RUNS
repetitions the root splits all sets on one token; a node of more than LIMIT sets is split again on CHILDREN sampled
tokens, up to DEPTH times while that separates sets, so that sets go on together only along tokens that they share.  Small nodes are leaves and are
compared by brute force on the embedded sets, in blocks if a node of alike sets stays large.  A pair of similarity 0.8 is
together in a run with probability over 0.76, so RUNS = 10 miss fewer than one in a million pairs; a pair whose
embeddings agree in fewer than AGREE of 32 tokens is passed over (below 1e-7 at 0.8).

An exact check follows: whatever is linked so far, directly or not, is one cluster; all pairs of a cluster get their exact
Jaccard similarity, as counts of common shingles in numpy, in blocks of bounded size.  Pairs are counted and united where
they are found and are never emitted, so output is linear in the documents also for groups of thousands of variants.

Words are lower-cased (A-Z) runs as in the decontamination operator.  A text of one to four words is one shingle.
Null, empty and wordless texts belong to no class: class_id and group_id are their doc_id, and they have no links.
Rows with the same doc_id and text are one document of their class; null ids come first in no order but are kept.
Ties at the threshold count as links.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, row_key, whole_rows
from tidemark.llm.components import components

WORDS, THRESHOLD = 5, 0.8
COORDINATES, RUNS, LIMIT, CHILDREN, DEPTH, AGREE = 32, 10, 512, 2, 3, 13
#: Sets, and shingles, in a block of brute force.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000

#: Separators become spaces and A-Z become a-z.
_TO_WORDS = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_ODD = np.random.default_rng(20_18).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    """Hashes of words; at most 100,000 of up to 64 bytes are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = value
        return value


_hashes = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The sorted set of hashed shingles."""
    words = (text or "").encode().translate(_TO_WORDS).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    total = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for j in range(min(size, len(h))):
        total += h[j : j + n] * _ODD[j]
    return np.unique(_mix(total))


def sketch(s: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, 1 << 32, np.uint64)
    for at in range(0, len(s), 8192):
        for k in range(COORDINATES):
            least[k] = min(least[k], (s[at : at + 8192] * _ODD[16 + k] >> np.uint64(32)).min())
    return least.astype(np.uint32).view(np.int32)


def _sketches(batches):
    for batch in batches:
        c1, c2, sk = [], [], []
        for x in batch.column(2):
            s = shingles(x.as_py())
            a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else (None, None)
            c1.append(a if a is None else int(a))
            c2.append(b if b is None else int(b))
            sk.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sk, pa.list_(pa.int32()))], names=["_d", "_t", "c1", "c2", "sk"])


def _labels(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row of its component."""
    m = len(near)
    label = np.arange(m)
    near = near | np.eye(m, dtype=bool)
    while True:
        new = np.array([label[row].min() for row in near])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _grouped(batches, keys: int):
    """Consecutive rows with equal first columns, over batches, as lists of slices."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def _leaf_links(batches):
    """(leaf, rid, sk), sorted by leaf: links between sets whose embeddings agree enough."""
    a, b = [], []
    for _, parts in _grouped(batches, 1):
        t = pa.Table.from_batches(parts).combine_chunks()
        rid = t.column("rid").to_numpy()
        rid, first = np.unique(rid, return_index=True)
        if len(rid) < 2:
            continue
        sk = t.column("sk").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)[first]
        same = np.zeros((len(rid), len(rid)), np.int8)
        for k in range(COORDINATES):
            same += sk[:, None, k] == sk[None, :, k]
        label = _labels(same >= AGREE)
        moved = label != np.arange(len(rid))
        a.append(rid[label[moved]])
        b.append(rid[moved])
        if sum(map(len, a)) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def common_counts(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Above the diagonal, how many values two sets share; the sets are concatenated."""
    m = len(sizes)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    df = np.diff(np.r_[starts, len(values)])
    counts = np.zeros((m, m), np.int32)
    flat = counts.ravel()
    for n in np.unique(df[(df >= 2) & (df <= 32)]):
        o = owner[starts[df == n][:, None] + np.arange(n)]
        for p in range(n - 1):
            np.add.at(flat, (o[:, p, None] * m + o[:, p + 1 :]).ravel(), 1)
    many = np.flatnonzero(df > 32)
    for at in range(0, len(many), 1024):
        x = np.zeros((m, len(part := many[at : at + 1024])), np.float32)
        for k, g in enumerate(part):
            x[owner[starts[g] : starts[g] + df[g]], k] = 1
        counts += np.triu(x @ x.T, 1).astype(np.int32)
    return counts


def _cluster_links(threshold: float):
    def run(batches):
        """(cluster, i, j, blocks, rid, block, s), sorted by the first three: each set's exact links, and the first set that it is united with."""
        for (_, i, j), parts in _grouped(batches, 3):
            t = pa.Table.from_batches(parts).combine_chunks()
            rid, first = np.unique(t.column("rid").to_numpy(), return_index=True)
            block = t.column("block").to_numpy()[first]
            s = t.column("s").combine_chunks()
            sets = [np.frombuffer(s[int(k)].as_buffer(), np.uint64) for k in first]
            sizes = np.array([len(x) for x in sets])
            m = len(rid)
            if m <= 12:
                common = np.zeros((m, m), np.int32)
                for p in range(m):
                    for q in range(p + 1, m):
                        if min(sizes[p], sizes[q]) >= threshold * max(sizes[p], sizes[q]) - 1e-9:
                            both = np.concatenate([sets[p], sets[q]])
                            both.sort()
                            common[p, q] = np.count_nonzero(both[1:] == both[:-1])
            else:
                common = common_counts(np.concatenate(sets), sizes)
            near = np.triu(common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9, 1)
            if i != j:
                near &= block[:, None] != block[None, :]
            near |= near.T
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(near.sum(1), pa.int64()), pa.array(rid[_labels(near)])], names=["rid", "n_links", "label"])

    return run


def _shingle_rows(batches):
    for batch in batches:
        s = [shingles(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], names=["rid", "cluster", "size", "s"])


def _blocked(rows: DataFrame, key: str, blocks) -> DataFrame:
    """rows with block, i and j: those of a key go to one cell, or to all cells of blocks that hold theirs."""
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


def _leaves(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf, rid) of all runs."""
    level = classes.select("rid", F.explode(F.array(*[F.xxhash64(F.lit(r), F.col("sk")[r]) for r in range(RUNS)])).alias("node"), F.lit(1 << 62).alias("above"))
    leaves = []
    for depth in range(DEPTH + 1):
        # written, so that neither side of the join is an aggregate and a node of very many sets can be split
        sizes = scratch.keep(level.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), f"sizes-{depth}")
        level = scratch.keep(level.join(sizes, "node"), f"level-{depth}")
        # a node that holds half of the one above is of sets so alike that splitting it only multiplies it
        done = (F.col("n") <= LIMIT) | (2 * F.col("n") > F.col("above"))
        leaves.append(level if depth == DEPTH else level.where(done))
        large = level.where(~done)
        if depth == DEPTH or not large.limit(1).count():
            break
        child = [F.xxhash64("node", F.lit(j), F.element_at("sk", F.pmod(F.xxhash64("node", F.lit(j)), F.lit(COORDINATES)).cast("int") + 1)) for j in range(CHILDREN)]
        level = large.join(classes.select("rid", "sk"), "rid").select("rid", F.explode(F.array(*child)).alias("node"), F.col("n").alias("above")).dropDuplicates(["rid", "node"])
    rows = leaves[0]
    for x in leaves[1:]:
        rows = rows.union(x)
    rows = _blocked(rows, "node", F.ceil(F.col("n") / BLOCK).cast("int"))
    return rows.select(F.when(F.col("blocks") == 1, F.col("node")).otherwise(F.xxhash64("node", "i", "j")).alias("leaf"), "rid")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, class_id (smallest doc_id with the same shingles), n_links (other classes at the
    threshold or above), group_id (smallest doc_id linked directly or not), keep (it represents its group), and _d, _t."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = scratch.keep(docs.select(*row_key(), F.col("text")).mapInArrow(_sketches, "_d " + dict(docs.dtypes)["doc_id"] + ", _t long, c1 long, c2 long, sk array<int>"), "rows")
    classes = (
        rows.where("c1 is not null")
        .groupBy("c1", "c2")
        .agg(F.min(F.struct("_d", "_t")).alias("rep"), F.min("_d").alias("class_id"), F.first("sk").alias("sk"))
        .select(F.monotonically_increasing_id().alias("rid"), "c1", "c2", "rep", "class_id", "sk")
    )
    classes = scratch.keep(classes, "classes")
    fed = _leaves(classes, scratch).join(classes.select("rid", "sk"), "rid").select("leaf", "rid", "sk").repartition("leaf").sortWithinPartitions("leaf")
    links = scratch.keep(fed.mapInArrow(_leaf_links, "a long, b long").distinct(), "links")
    clusters = components(links, scratch, "clusters")
    wanted = clusters.join(classes, clusters["node"] == classes["rid"]).select("rid", F.col("label").alias("cluster"), F.col("rep._d").alias("_wd"), F.col("rep._t").alias("_wt"))
    texts = docs.select(*row_key(), F.col("text"))
    texts = texts.join(wanted, texts["_d"].eqNullSafe(wanted["_wd"]) & (texts["_t"] == wanted["_wt"])).select("rid", "cluster", "text")
    sets = scratch.keep(texts.mapInArrow(_shingle_rows, "rid long, cluster long, size long, s binary"), "sets")
    sizes = sets.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    cells = _blocked(sets.join(sizes, "cluster"), "cluster", F.col("n_blocks")).select("cluster", "i", "j", "block", "rid", "s")
    cells = cells.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    exact = scratch.keep(cells.mapInArrow(_cluster_links(threshold), "rid long, n_links long, label long"), "exact")
    scratch.drop("sets")
    n_links = exact.groupBy("rid").agg(F.sum("n_links").alias("n_links"))
    united = components(exact.select(F.col("label").alias("a"), F.col("rid").alias("b")), scratch, "groups")
    of = classes.join(n_links, "rid", "left").join(united.withColumnRenamed("node", "rid"), "rid", "left")
    of = scratch.keep(of.select("c1", "c2", "rep", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("label", "rid").alias("label")), "of")
    groups = of.groupBy("label").agg(F.min("class_id").alias("group_id"), F.min("rep").alias("group_rep"))
    of = of.join(groups, "label").withColumnsRenamed({"c1": "_c1", "c2": "_c2"}).drop("rep")
    out = rows.join(of, (rows["c1"] == of["_c1"]) & (rows["c2"] == of["_c2"]), "left")
    none = F.col("c1").isNull()
    return out.select(
        F.col("_d").alias("doc_id"), F.when(none, F.col("_d")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(none, F.col("_d")).otherwise(F.col("group_id")).alias("group_id"),
        (none | (F.col("_d").eqNullSafe(F.col("group_rep._d")) & (F.col("_t") == F.col("group_rep._t")))).alias("keep"), "_d", "_t",
    )


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group; documents without words stay."""
    found = near_duplicates(docs, threshold).where("keep").groupBy(F.col("_d").alias("_kd"), F.col("_t").alias("_kt")).agg(F.count("*").alias("_n"), F.first(F.col("class_id").isNotNull()).alias("_any"))
    keyed = whole_rows(docs)
    kept = keyed.join(found, keyed["_d"].eqNullSafe(found["_kd"]) & (keyed["_t"] == found["_kt"]))
    once, repeated = kept.where("_n = 1"), kept.where("_n > 1")
    return once.union(repeated.dropDuplicates(["_d", "_t"])).select("_row.*")
