"""Toxicity by non-negative positive-unlabelled learning.

Texts become sets of words and of word beginnings (4, 5 and 6 letters, which stand for inflected forms).  The classifier is
linear over at most FEATURES that are commonest in confirmed toxic texts as against unlabelled ones, and is trained in numpy on the
risk  p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic)),  where p, the class prior, is the share of toxic among all labels
that may be learned from.  The score is a logistic of the linear form.

Fitting uses at most POSITIVES toxic and UNLABELLED other texts, those of smallest hash, of different content; counts of
labels cover all.  Scoring reads every whole text.

Null, empty and wordless texts get the score of no feature.  Label rows without id or label teach nothing; of several
for one document, one that says toxic decides.  Without any toxic label all scores are 0.  Repeated rows get equal scores,
ties at 0.5 count as toxic, and texts of any length are read whole.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bucket, smallest

FOLDS, HELD_OUT = 5, 0
POSITIVES, UNLABELLED, FEATURES, SPACE = 4000, 8000, 2048, 1 << 20
#: Standard errors by which a feature must be commoner in toxic texts.
LEAST = 1.5
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in (4, 5, 6)))


def hashed(text: str | None) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(x.encode()) % SPACE for x in terms(text)), np.int32))


def _features(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashed(x.as_py()).tobytes() for x in batch.column(1)], pa.binary()), batch.column(2)], names=["toxic", "x", "h"])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """The class prior, and the features of toxic and of unlabelled texts."""
    own = F.coalesce(bucket("doc_id", FOLDS) != HELD_OUT, F.lit(False))
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = scratch.keep(labels.where(own & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "known")
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    toxic = smallest(known.where("toxic = 1"), F.xxhash64("doc_id"), POSITIVES)
    free = smallest(docs.where(own).select("doc_id"), F.xxhash64(F.lit(1), "doc_id"), UNLABELLED).select("doc_id", F.lit(0).alias("toxic"))
    chosen = toxic.union(free)  # at most POSITIVES + UNLABELLED rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("toxic", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    texts = scratch.keep(texts.select("toxic", "text", "h").mapInArrow(_features, "toxic int, x binary, h long"), "texts")
    # once more, as an id may stand for many texts
    of = lambda k, n: [np.frombuffer(x, np.int32) for x in sorted(bytes(r["x"]) for r in smallest(texts.where(F.col("toxic") == k), F.col("h"), n).collect())]
    found = prior, of(1, POSITIVES), of(0, UNLABELLED)
    scratch.drop("known", "texts")
    return found


def _matrix(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    at = np.full(SPACE, -1, np.int32)
    at[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for k, r in enumerate(rows):
        c = at[r]
        x[k, c[c >= 0]] = 1
    return x


def fit(prior: float, toxic: list[np.ndarray], free: list[np.ndarray], steps: int = 300, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashed features, their weights, and the bias."""
    if not toxic or not free or prior <= 0:
        return np.empty(0, np.int32), np.empty(0), -50.0
    counts = [np.bincount(np.concatenate(rows), minlength=SPACE) for rows in (toxic, free)]
    p, u = (c / len(r) for c, r in zip(counts, (toxic, free), strict=True))
    differ = (p - u) / np.sqrt(p / len(toxic) + u / len(free) + 1e-6)  # in standard errors
    chosen = np.sort(np.argsort(-differ, kind="stable")[:FEATURES])
    chosen = chosen[(differ[chosen] > LEAST) & (counts[0][chosen] > 1)].astype(np.int32)
    xp, xu = _matrix(toxic, chosen), _matrix(free, chosen)
    w, b = np.zeros(len(chosen), np.float32), np.float32(-1)
    moments = [np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)]
    for step in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) for x in (xp, xu))
        dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        gp = np.r_[dp @ xp, dp.sum()]  # of the mean of s over toxic texts
        gu = np.r_[du @ xu, du.sum()]
        negative = su.mean() - prior * sp.mean()
        # R+ is the mean of 1 - s, R- that of s; where the corrected negative risk is below 0, it is brought back up
        g = -prior * gp + (gu - prior * gp) if negative >= 0 else -(gu - prior * gp)
        g[:-1] += decay * w
        for m, (keep, now) in zip(moments, ((0.9, g), (0.999, g * g)), strict=True):
            m *= keep
            m += (1 - keep) * now
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1].astype(np.float32)
        b -= np.float32(move[-1])
    return chosen, w.astype(float), float(b)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; the model has at most FEATURES weights."""
    chosen, w, b = model

    def run(batches):
        weight = dict(zip(chosen.tolist(), w.tolist(), strict=True))
        known: dict[str, tuple[int, ...]] = {}  # the chosen features of a word and of its beginnings

        def of(word: str) -> tuple[int, ...]:
            found = known.get(word)
            if found is None:
                if len(known) > 300_000:
                    known.clear()
                found = known[word] = tuple(f for x in {word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n)} if (f := zlib.crc32(x.encode()) % SPACE) in weight)
            return found

        for batch in batches:
            z = [b + sum(map(weight.__getitem__, sorted(set().union(*map(of, set(_WORD.findall((x.as_py() or "").lower()))))))) for x in batch.column(2)]
            s = 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    fed = docs.select("doc_id", F.coalesce(bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return fed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(*sample(docs, labels)))
