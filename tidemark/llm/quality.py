"""Quality by naive Bayes support vectors.

A text becomes indicators of n-grams of one to four character classes (runs of lower-case, of upper-case letters, digits,
blanks, and each punctuation mark; bytes beyond ASCII are skipped), of the word n-grams in which a word is repeated
three, four, six or twelve times in a row, and of what is written: words, and two and three characters in a row, over the
letters and marks of all of Unicode, lower-cased and hashed to HASHED values (what is between them counts as one blank).
The shapes and the letters of a text are scaled to the same length, each by itself.  Indicators are scaled by the log ratio of their smoothed counts in good and bad
texts; on these, a linear hinge loss is minimised by dual coordinate descent, and the weights are drawn toward their mean
size.  A logistic of the margin, fitted on margins of left-out parts, is the score.

Fitting uses at most PER_CLASS labelled texts a class, those of smallest hash, of different content, weighed by the class
counts of all labels.  Scoring reads every whole text.

Null and empty texts have no indicator and get the score of the bias.  Label rows without id or label teach nothing; of
several for one document the lowest decides.  If one class is missing, all get the other.  Repeated rows get equal scores,
ties at 0.5 count as good, and texts of any length are read whole.  An empty table gives an empty result.  `quality` ignores other
columns; `keep_good` returns them all, also those named like an output.
"""

from __future__ import annotations

import functools
import operator
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bucket, smallest, trim

FOLDS, HELD_OUT = 3, 1
PER_CLASS, LEAST, N = 4000, 5, 4
_CLASSES = 40
SHAPES, HASHED = _CLASSES**N + 4, 1 << 20
SPACE = SHAPES + HASHED
_RUNS = (3, 4, 6, 12)


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 1, 2, 3
    table[[9, 32]], table[[10, 13]] = 4, 5
    marks = [c for c in range(33, 127) if table[c] == 0]
    table[marks] = np.arange(6, 6 + len(marks))
    return table


_TABLE = _class_table()


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters or marks."""
    return np.fromiter((unicodedata.category(chr(k))[0] in "LM" for k in range(0x110000)), bool, 0x110000)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes spread over the codes after the shapes."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(44)) % np.uint64(HASHED)).astype(np.int32) + SHAPES


def letter_codes(text: str | None) -> list[np.ndarray]:
    """Hashed words and runs of two and three characters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    own = _letters()[c]
    if not own.any():
        return []
    c = np.where(own, c, 32)
    stay = own.copy()
    stay[1:] |= own[:-1]  # of what is between letters, the first
    c, own = np.r_[32, c[stay], 32].astype(np.uint64), np.r_[False, own[stay], False]
    out = []
    for n in (2, 3):
        h = np.full(len(c) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : len(c) - n + 1 + j]
        out.append(_mixed(h))
    edges = np.flatnonzero(np.diff(own.astype(np.int8)))
    begin, end = edges[::2] + 1, edges[1::2] + 1
    at = np.arange(len(c)) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, len(c)]))
    spread = (c + np.uint64(1)) * (at.astype(np.uint64) * np.uint64(0x94D049BB133111EB) + np.uint64(0x9E3779B97F4A7C15))
    spread = (spread ^ (spread >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    total = np.r_[np.uint64(0), np.cumsum(np.where(own, spread, np.uint64(0)), dtype=np.uint64)]
    out.append(_mixed(total[end] - total[begin]))
    return out


def codes(text: str | None) -> np.ndarray:
    """All n-gram codes, with repeats."""
    text = text or ""
    c = _TABLE[np.frombuffer(text.encode(), np.uint8)]
    c = c[c > 0]
    if len(c):
        c = c[np.r_[True, (c[1:] != c[:-1]) | (c[1:] > 5)]].astype(np.int32)
    out = []
    for n in range(1, N + 1):
        if len(c) >= n:
            code = c[: len(c) - n + 1].copy()
            for j in range(1, n):
                code = code * _CLASSES + c[j : len(c) - n + 1 + j]
            out.append(code)
    words = text.split()
    if len(words) >= _RUNS[0]:
        same = np.fromiter(map(operator.eq, words, words[1:]), bool, len(words) - 1)
        ends = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        longest = int((ends[1::2] - ends[::2]).max()) + 1 if len(ends) else 1
        out.append(np.array([_CLASSES**N + k for k, n in enumerate(_RUNS) if longest >= n], np.int32))
    out += letter_codes(text)
    return np.concatenate(out) if out else np.empty(0, np.int32)


def _lengths(shape: np.ndarray) -> np.ndarray:
    """What scales the indicators of a text, of which `shape` says which are shapes."""
    n = np.count_nonzero(shape)
    return np.where(shape, 1 / np.sqrt(max(1, n)), 1 / np.sqrt(max(1, len(shape) - n)))


def _features(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(codes(x.as_py())).tobytes() for x in batch.column(1)], pa.binary()), batch.column(2)], names=["quality", "x", "h"])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, int], list[np.ndarray], np.ndarray]:
    """Counts of all usable labels, and features and labels of the chosen texts."""
    own = F.coalesce(bucket("doc_id", FOLDS) != HELD_OUT, F.lit(False))
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.where(own & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = scratch.keep(known, "known")
    counts = {int(r[0]): r[1] for r in known.groupBy("quality").count().collect()}
    of = lambda df, h: [smallest(df.where(F.col("quality") == k), h, PER_CLASS) for k in (0, 1)]
    chosen = reduce(DataFrame.union, of(known, F.xxhash64("doc_id")))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("quality", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    texts = scratch.keep(texts.select("quality", "text", "h").mapInArrow(_features, "quality int, x binary, h long"), "texts")
    # once more, as an id may stand for many texts
    rows = sorted((bytes(r["x"]), r["quality"]) for part in of(texts, F.col("h")) for r in part.collect())
    scratch.drop("known", "texts")
    return counts, [np.frombuffer(x, np.int32) for x, _ in rows], np.array([y for _, y in rows])


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, shape: np.ndarray, y: np.ndarray, cost: float, rounds: int = 12) -> np.ndarray:
    """Weights, the last of them the bias, of the linear hinge loss over indicators scaled by `ratio` and to the length of a text."""
    size = len(ratio)
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    values = lambda r: ratio[r] * _lengths(shape[r])  # noqa: E731  (made anew each time, as all of them take much memory)
    square = np.array([v @ v + 1 for v in map(values, rows)])
    order = np.random.default_rng(5)
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            i, v = rows[k], values(rows[k])
            step = min(max(alpha[k] - (y[k] * (w[i] @ v + w[size]) - 1) / square[k], 0.0), cost) - alpha[k]
            if step:
                alpha[k] += step
                w[i] += step * y[k] * v
                w[size] += step * y[k]
    return w


def _count(rows: list[np.ndarray], size: int) -> np.ndarray:
    """How many rows have each of `size` features; a row has none twice."""
    n = np.zeros(size, np.int32)
    for r in rows:
        n[r] += 1
    return n


def _train(x: list[np.ndarray], y: np.ndarray, cost: float, toward: float) -> tuple[np.ndarray, np.ndarray, float]:
    n = _count(x, SPACE)
    chosen = np.flatnonzero(n >= LEAST).astype(np.int32)
    at = np.full(SPACE, -1, np.int32)
    at[chosen] = np.arange(len(chosen))
    rows = [c[c >= 0] for c in (at[r] for r in x)]
    good, bad = (1.0 + _count([r for r, k in zip(rows, y, strict=True) if k == c], len(chosen)) for c in (1, 0))
    shape = chosen < SHAPES
    ratio = np.empty(len(chosen))
    for own in (shape, ~shape):
        ratio[own] = np.log((good[own] / good[own].sum()) / (bad[own] / bad[own].sum()))
    w = dual_coordinate_descent(rows, ratio, shape, np.where(y == 1, 1, -1), cost)
    w, b = w[:-1], w[-1]
    w = toward * np.abs(w).mean() + (1 - toward) * w
    return chosen, w * ratio, b


def fit(counts: dict[int, int], x: list[np.ndarray], y: np.ndarray, cost: float = 1.0, toward: float = 0.1) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Features, weights, bias, and slope and intercept of the logistic."""
    if len(set(y.tolist())) < 2:
        return np.empty(0, np.int32), np.empty(0), 0.0, 0.0, 50.0 if counts.get(1, 0) >= counts.get(0, 0) else -50.0
    margins, fold = np.zeros(len(x)), np.arange(len(x)) % 3
    for k in range(3):
        own = [r for r, f in zip(x, fold, strict=True) if f != k]
        if len(set(y[fold != k].tolist())) == 2:
            model = _train(own, y[fold != k], cost, toward)
            margins[fold == k] = [margin(r, model) for r, f in zip(x, fold, strict=True) if f == k]
    share = np.array([counts.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)])
    weight = (share / share.mean())[y]
    slope, intercept = 1.0, 0.0
    for _ in range(50):  # Newton steps of weighted logistic regression on the margins, slightly damped
        p = 1 / (1 + np.exp(-np.clip(slope * margins + intercept, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p)
        a = np.array([[(h * margins**2).sum() + 1e-2, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-2]])
        d = np.linalg.solve(a, [(g * margins).sum() + 1e-2 * slope, g.sum() + 1e-2 * intercept])
        slope, intercept = slope - np.clip(d[0], -5, 5), intercept - np.clip(d[1], -5, 5)
    return *_train(x, y, cost, toward), float(slope), float(intercept)


def margin(present: np.ndarray, model: tuple) -> float:
    chosen, w, b = model[:3]
    k = np.searchsorted(chosen, present)
    k = k[(k < len(chosen)) & (chosen[np.minimum(k, len(chosen) - 1)] == present)] if len(chosen) else np.empty(0, int)
    return float(w[k] @ _lengths(chosen[k] < SHAPES) + b) if len(k) else float(b)


def score(docs: DataFrame, model: tuple, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id) with held_out, score, predicted for every row; the model is bounded by the feature space."""
    keep = keep or ["doc_id"]
    chosen, w, b, slope, intercept = model

    def run(batches):
        at = np.full(SPACE, len(chosen), np.int32)
        at[chosen] = np.arange(len(chosen))
        weight, seen, n_shapes = w, np.zeros(len(chosen) + 1, bool), int(np.searchsorted(chosen, SHAPES))
        for batch in batches:
            z = []
            for x in batch.column(batch.num_columns - 1):
                seen[:] = False
                seen[at[codes(x.as_py())]] = True
                parts = (slice(0, n_shapes), slice(n_shapes, len(chosen)))
                z.append(sum(weight[p] @ seen[p] / np.sqrt(max(1, np.count_nonzero(seen[p]))) for p in parts) + b)
            s = 1 / (1 + np.exp(-np.clip(slope * np.array(z, float) + intercept, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "held_out", "score", "predicted"])
        trim()

    held = F.coalesce(bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    fed = docs.select(*keep, held.alias("held_out"), F.col("text").alias("__text"))
    return fed.mapInArrow(run, ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep) + ", held_out boolean, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    model = fit(*sample(docs, labels))
    trim()
    return model


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects."""
    model = learn(docs, labels)
    columns = docs.columns
    plain = [c for c in columns if c not in ("held_out", "score", "predicted")]
    if plain == columns:
        return score(docs, model, columns).where("predicted = 1").select(*columns)
    renamed = docs.withColumnsRenamed({c: f"__{c}" for c in columns if c not in plain})
    kept = score(renamed, model, renamed.columns).where("predicted = 1").select(*renamed.columns)
    return kept.withColumnsRenamed({f"__{c}": c for c in columns if c not in plain})
