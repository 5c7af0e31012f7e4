"""URL filters: host and path rules, and gradient-boosted trees on lexical features for URLs that no rule fits.

The trees are trained in numpy on labelled URLs (at most SAMPLE, those of smallest hash): logistic loss, histograms of
BINS quantile bins, TREES trees of depth DEPTH.  Features are lengths, depth, digit ratio, entropy, counts of labels,
hyphens and parameters, and how the labels of host suffixes (the last label, the last two) are blocked on average (smoothed).
These rates are counted over all labelled URLs, for every suffix, and joined to the URLs that are judged; no table of them is
collected.  A URL that is learned from is left out of its own rates.

A null URL, or one without "://", has an empty host and path; no rule with a host fits, and the trees judge it by its
features.  Without labels, or with those of one kind only, the verdict is that kind, or allow.  A rule fits its host and
all subdomains if the path starts with the rule's; the longest wins, of equally long ones the last in order of its text,
and of equal ones "block".  Repeated URLs get equal verdicts.  URLs of any length are read whole; an empty table gives an empty result.
Columns named like an output are replaced by it; any other passes through, whatever its name.
"""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, Scratch, smallest

SAMPLE, BINS, TREES, DEPTH, RATE = 20_000, 32, 60, 3, 0.2
#: Rules up to this number are compared in the row; more are joined by host.
IN_ROW = 200
_PARTS = re.compile(r"^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls (with url) as a column `row`, and url, host, path, rule and ruled.  rules: (verdict, host, path)."""
    out = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row"), "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    if len(rules) <= IN_ROW:
        found: Column = F.lit(None).cast("struct<n:int,rule:string,ruled:string>")
        for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0])):
            fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
            found = F.when(fits, F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("ruled"))).otherwise(found)
        return out.withColumn("found", found).select(*out.columns, "found.rule", "found.ruled")
    spark = urls.sparkSession
    known = spark.createDataFrame(rules, "ruled string, suffix string, start string").withColumn("rule", F.concat("suffix", "start"))
    labels = F.split("host", r"\.", -1)
    keys = out.select("host", "path").distinct()
    ends = keys.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    best = ends.join(known, "suffix").where(F.expr("startswith(path, start)")).groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "ruled")).alias("found"))
    return out.join(best, ["host", "path"], "left").select(*out.columns, "found.rule", "found.ruled")


def _suffix(n: int) -> Column:
    labels = F.split(host(F.col("url")), r"\.", -1)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def _rate(blocked: float, n: float, prior: float, own: int | None) -> float:
    """The share of blocked URLs among those with a suffix, without the one whose own label is given."""
    if own is not None and n > 0:
        blocked, n = blocked - own, n - 1
    return (blocked + 10 * prior) / (n + 10)


def features(url: str | None, counts: tuple[float, float, float, float], prior: float, own: int | None = None) -> list[float]:
    """counts: the blocked URLs and all, of those that end in the host's last label and in its last two."""
    url = url or ""
    m = _PARTS.match(url)
    h, p, q = (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")
    n = max(1, len(url))
    spread = Counter(url)
    return [
        len(url), len(h), len(p), len(q), p.count("/"), h.count(".") + 1, h.count("-"), p.count("-"),
        sum(map(str.isdigit, url)) / n, -sum(c / n * math.log2(c / n) for c in spread.values()),
        q.count("&") + bool(q), q.count("="), float("#" in url), float(url.startswith("https")), float(p.endswith(".html")), float(h.startswith("www.")),
        _rate(*counts[:2], prior, own), _rate(*counts[2:], prior, own),
    ]


class Trees:
    """Boosted trees: per tree the split features and bins of its inner nodes, level by level, and its leaves' values."""

    def __init__(self, base: float, edges: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], prior: float):
        self.base, self.edges, self.trees, self.prior = base, edges, trees, prior

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def margins(self, binned: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(binned), self.base), np.arange(len(binned))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(binned), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def __call__(self, urls: list[str | None], counts: list[tuple[float, float, float, float]]) -> np.ndarray:
        """Probability that each is to be blocked."""
        if not urls:
            return np.empty(0)
        x = np.array([features(u, c, self.prior) for u, c in zip(urls, counts, strict=True)], float)
        return 1 / (1 + np.exp(-np.clip(self.margins(self.bins(x)), -50, 50)))


def train(urls: list[str | None], blocked: list[int], counts: list[tuple[float, float, float, float]]) -> Trees:
    """counts: of each URL, as `features` has them."""
    y = np.array(blocked, float)
    if not len(y) or y.min() == y.max():
        return Trees(50.0 if len(y) and y[0] else -50.0, [], [], 0.0)
    prior = float(y.mean())
    x = np.array([features(u, c, prior, b) for u, c, b in zip(urls, counts, blocked, strict=True)], float)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model = Trees(math.log(prior / (1 - prior)), edges, [], prior)
    binned, rows = model.bins(x), np.arange(len(x))
    margin = np.full(len(x), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS)
        at = np.zeros(len(x), int)
        for level in range(DEPTH):
            nodes, first = 2**level, 2**level - 1
            local, best = at - first, np.full(nodes, 1e-6)
            for k in range(x.shape[1]):
                key = local * BINS + binned[:, k]
                gs, hs = (np.bincount(key, w, nodes * BINS).reshape(nodes, BINS).cumsum(1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                where = gain.argmax(1)
                top = gain[np.arange(nodes), where]
                better = top > best
                best[better] = top[better]
                feature[first : first + nodes][better], cut[first : first + nodes][better] = k, where[better]
            at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
        leaf_of = at - (2**DEPTH - 1)
        leaf = -RATE * np.bincount(leaf_of, g, 2**DEPTH) / (np.bincount(leaf_of, h, 2**DEPTH) + 1)
        model.trees.append((feature, cut, leaf))
        margin += leaf[leaf_of]
    return model


def counted(known: DataFrame) -> DataFrame:
    """(suffix, n_labels, blocked, n): how many labelled URLs (url, blocked) end in each, and are to be blocked."""
    ends = known.select("blocked", F.inline(F.array(*[F.struct(_suffix(n).alias("suffix"), F.lit(n).alias("n_labels")) for n in (1, 2)])))
    return ends.groupBy("suffix", "n_labels").agg(F.sum(F.col("blocked").cast("double")).alias("blocked"), F.count("*").cast("double").alias("n"))


def with_counts(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """urls (with url) and `counts`, as `features` has them; zeros for suffixes that no labelled URL has."""
    out = urls
    for n in (1, 2):
        mine = counts.where(F.col("n_labels") == n).select(F.col("suffix").alias(f"suffix{n}"), F.col("blocked").alias(f"blocked{n}"), F.col("n").alias(f"n{n}"))
        out = out.withColumn(f"suffix{n}", _suffix(n)).join(mine, f"suffix{n}", "left")
    return out.select(*urls.columns, F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("blocked1", "n1", "blocked2", "n2")]).alias("counts"))


def learn(labelled: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> tuple[Trees, DataFrame]:
    """The trees, and the counts of all suffixes.  labelled: url, blocked (0 or 1)."""
    known = scratch.keep(labelled.where("url is not null and blocked is not null").groupBy("url").agg(F.max("blocked").alias("blocked")), "known")
    counts = scratch.keep(counted(known), "counts")
    rows = with_counts(smallest(known, F.xxhash64("url"), sample), counts).collect()
    scratch.drop("known")
    rows.sort(key=lambda r: r["url"])
    return train([r["url"] for r in rows], [int(r["blocked"]) for r in rows], [tuple(r["counts"]) for r in rows]), counts


def filter_urls(urls: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """urls with host, path, rule, verdict, block_score.  Without labelled URLs, those that a rule decides teach the trees."""
    scratch = Scratch(urls.sparkSession, "urls")
    ruled = with_rules(urls, rules)
    if labelled is None:
        labelled = ruled.where("ruled is not null").select("url", (F.col("ruled") == "block").cast("int").alias("blocked"))
    model, counts = learn(labelled, scratch)

    @F.pandas_udf("double")
    def judge(url: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series(model([u if isinstance(u, str) else None for u in url], list(counts)))

    judged = with_counts(ruled, counts).withColumn("block_score", judge("url", "counts"))
    own = {"host", "path", "rule", "verdict", "block_score"}
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict")
    return judged.select(*[F.col("row")[c].alias(c) for c in urls.columns if c.lower() not in own], "host", "path", "rule", verdict, "block_score")
