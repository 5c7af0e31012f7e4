"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

1. Index: the documents are split into words once, and the postings of all benchmark terms (term, document, position) are
   written; a posting of no term at position 0 tells how many words a document has.
2. Posting lists are counted.  Each window of ten item words is a list of terms with offsets, from the rarest term on;
   windows with a term that the corpus lacks go.
3. Intersection: the list of the rarest term, shifted by its offset, gives the places where a window may begin.  They are
   intersected with the shifted list of the second rarest term, and what is left, which is little, with all other lists of
   the documents left at once.  Joins are by document, position and term, so no term and no document is a hot key.
4. A place that is in all lists of a window is an exact phrase.  The words of all phrases of a document are counted once.

Proximity matches (`near`) are stretches of ten document words that hold NEAR of the different terms of a window, in any
order.  A window is represented by one term more than a match may lack, from the rarest on; at each of their postings the
document words beside it are compared with the windows around the term.  This reads the documents once more for these
anchors, as joining all lists within ten places is far more than the words beside a posting.  Anchors are broadcast in
blocks of at most BLOCK; a larger benchmark takes more passes.

No other broadcast is asked for: Spark makes one where a written table is below its threshold, and else shuffles.
Every document word is examined, and all lists are whole.

Null and empty texts have no words, hit nothing, and are returned.  Texts of any length are read whole.  Items without words
have no window.  Items with equal words share their windows, and each counts.  A null item_id can hit words but is not counted
among the items.  Rows that agree in doc_id and text are indexed once and get equal results; a null doc_id is a value like others.  Other columns are
ignored.  An empty table of documents gives an empty result, one of items hits nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, lower_az, one_of_each, raw_words, row_key

WINDOW = 10
#: Of a window's terms, the share that makes a proximity match.
NEAR = 0.8
#: Anchors in a broadcast; each has at most 19 words.
BLOCK = 50_000


def _items(benchmark: DataFrame) -> DataFrame:
    words = F.transform(raw_words(F.col("text")), lower_az)
    return (
        benchmark.select(F.col("item_id").cast("string").alias("id"), words.alias("words"))
        .where(F.size("words") > 0)
        .groupBy("words")
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )


def index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings (_d, _t, pos, tid) of the terms (term, tid) in all texts (_d, _t, text), from position 1 on; at 0 stands,
    with tid -1, the number n of the text's words."""
    marked = terms.union(texts.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("tid")))  # of known size, to be broadcast
    words = texts.select("_d", "_t", raw_words(F.col("text")).alias("words"))
    places = words.select("_d", "_t", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "raw"))
    found = places.withColumn("term", lower_az(F.col("raw"))).join(marked, "term")
    return found.select("_d", "_t", F.when(F.col("pos") == 0, F.col("n")).alias("n"), "pos", "tid")


def windows(items: DataFrame, terms: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(need, ids, x) with a number wid: the windows all of whose terms the corpus has, x being (offset, tid) from the rarest term on."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0))))
    cut = items.select("ids", starts.alias("start"), "words").select("ids", F.slice("words", F.col("start") + 1, window).alias("said"))
    once = cut.groupBy("said").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    known = terms.join(counts, "tid")
    named = once.select("said", "ids", F.posexplode("said").alias("off", "term")).join(known, "term")
    sorted_ = named.groupBy("said").agg(F.first("ids").alias("ids"), F.sort_array(F.collect_list(F.struct("n", "off", "tid"))).alias("x"))
    whole = sorted_.where(F.size("x") == F.size("said"))
    return whole.select(F.monotonically_increasing_id().alias("wid"), F.size("x").alias("need"), "ids", F.transform("x", lambda y: F.struct(y["off"], y["tid"])).alias("x"))


def _same_place(a: DataFrame, b: DataFrame) -> Column:
    return (a["tid"] == b["tid"]) & (a["pos"] == b["pos"]) & (a["_t"] == b["_t"]) & a["_d"].eqNullSafe(b["_d"])


def phrases(postings: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(_d, _t, s, wid): where which windows stand in full; s is the position of the first word."""
    rarest = wanted.select("wid", "x", F.col("x")[0]["off"].alias("off"), F.col("x")[0]["tid"].alias("tid"))
    begin = postings.join(rarest, "tid").select("_d", "_t", (F.col("pos") - F.col("off")).alias("s"), "wid", "x").where("s > 0")
    whole = begin.where(F.size("x") == 1).select("_d", "_t", "s", "wid")
    second = begin.where(F.size("x") > 1).select("_d", "_t", "s", "wid", (F.col("s") + F.col("x")[1]["off"]).alias("pos"), F.col("x")[1]["tid"].alias("tid"), F.slice("x", F.lit(3), F.size("x")).alias("rest"))
    second_terms = wanted.where(F.size("x") > 1).select(F.col("x")[1]["tid"].alias("tid")).distinct()
    lists = postings.join(second_terms, "tid", "left_semi").select("_d", "_t", "pos", "tid")
    left = scratch.keep(second.join(lists, _same_place(second, lists)).select(second["_d"], second["_t"], "s", "wid", "rest"), "begun")
    open_ = left.select("_d", "_t", "s", "wid", F.size("rest").alias("n"), F.explode("rest").alias("y"))
    open_ = scratch.keep(open_.select("_d", "_t", "s", "wid", "n", (F.col("s") + F.col("y.off")).alias("pos"), F.col("y.tid").alias("tid")), "open")
    docs = scratch.keep(left.select(F.col("_d").alias("d"), F.col("_t").alias("t")).distinct(), "begun-docs")
    theirs = postings.join(docs, postings["_d"].eqNullSafe(docs["d"]) & (postings["_t"] == docs["t"]), "left_semi").select("_d", "_t", "pos", "tid")
    there = open_.join(theirs, _same_place(open_, theirs)).select(open_["_d"], open_["_t"], "s", "wid", "n")
    full = there.groupBy("_d", "_t", "s", "wid", "n").agg(F.count("*").alias("c")).where("c = n").select("_d", "_t", "s", "wid")
    return whole.union(left.where(F.size("rest") == 0).select("_d", "_t", "s", "wid")).union(full)


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, near: float = NEAR) -> DataFrame:
    """For each item, the positions that stand for its windows, with the words around them."""
    size = F.size("words")
    windows = items.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(size - window, F.lit(0))))).withColumn("need", F.least(size, F.lit(window)))
    terms = windows.select("words", "start", F.posexplode(F.slice("words", F.col("start") + 1, F.col("need"))).alias("off", "term"))
    ranked = terms.join(counts, "term", "left").groupBy("words", "start", "term").agg(F.first(F.coalesce("n", F.lit(0))).alias("n"), F.min(F.col("start") + F.col("off")).alias("at"))
    ranked = ranked.groupBy("words", "start").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("x"))
    spare = F.size("x") - F.ceil(near * F.size("x") - F.lit(1e-9)).cast("int") - F.size(F.filter("x", lambda x: x["n"] == 0))  # terms that a match may lack besides
    some = ranked.select("words", F.filter("x", lambda x: x["n"] > 0).alias("x"), spare.alias("spare")).where("spare >= 0")
    chosen = some.select("words", F.explode(F.slice("x", 1, F.col("spare") + 1)).alias("x")).select("words", F.col("x.at").alias("at"), F.col("x.term").alias("term")).distinct()
    reach, at = F.lit(window - 1), F.col("at")
    return chosen.join(items, "words").select(
        "term",
        "ids",
        F.least(F.size("words"), F.lit(window)).alias("need"),
        F.reverse(F.slice("words", F.greatest(at - reach, F.lit(0)) + 1, F.least(at, reach))).alias("left"),
        F.slice("words", at + 2, reach).alias("right"),
    )


def near_matches(docs: DataFrame, found: DataFrame, window: int = WINDOW, near: float = NEAR) -> DataFrame:
    """(_d, _t, ids): proximity matches, exact ones among them."""
    reach, pos = window - 1, F.col("pos")
    before = F.slice("words", F.greatest(pos - reach, F.lit(0)) + 1, F.least(pos, F.lit(reach)))
    cut = F.array(F.struct(before.alias("my_left"), F.slice("words", pos + 2, reach).alias("my_right")))
    rows = docs.select(*row_key(), raw_words(F.col("text")).alias("words")).select("_d", "_t", "words", F.posexplode("words").alias("pos", "raw"))
    rows = rows.withColumn("term", lower_az(F.col("raw"))).join(F.broadcast(found), "term")
    # cut out in a generator: conditions on it stay above it, and out of the join, which they would keep from being compiled
    rows = rows.select("_d", "_t", "term", "ids", "need", "left", "right", F.inline(cut))
    mine = F.concat(F.transform("my_left", lower_az), F.array("term"), F.transform("my_right", lower_az))
    rows = rows.withColumns({"around": F.concat(F.reverse("left"), F.array("term"), "right"), "at": F.size("my_left"), "mine": mine})
    terms = lambda k: F.array_distinct(F.slice("around", k + 1, F.col("need")))
    stretches = F.transform(F.sequence(F.greatest(F.col("at") - reach, F.lit(0)), F.greatest(F.least(F.col("at"), F.size("mine") - window), F.lit(0))), lambda k: F.slice("mine", k + 1, window))
    enough = lambda k: F.exists(stretches, lambda m: F.size(F.array_intersect(terms(k), m)) >= near * F.size(terms(k)) - 1e-9)
    # most have too few of a window's terms anywhere beside them
    likely = lambda k: F.size(F.array_intersect(terms(k), F.col("mine"))) >= near * F.size(terms(k)) - 1e-9
    nearby = F.exists(F.sequence(F.lit(0), F.size("around") - F.col("need")), lambda k: F.when(likely(k), enough(k)).otherwise(False))
    return rows.where(nearby).select("_d", "_t", "ids")


def _covered(spans: Column) -> Column:
    """Positions in a sorted array of spans, each once."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["last"].cast("long") - F.greatest(x["first"].cast("long") - 1, acc["end"]))).alias("n"),
            F.greatest(acc["end"], x["last"].cast("long")).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def _near_ids(docs: DataFrame, items: DataFrame, counts: DataFrame, scratch: Scratch, window: int, near: float) -> DataFrame:
    chosen = scratch.keep(anchors(items, counts, window, near), "anchors")
    blocks = max(1, -(-chosen.count() // BLOCK))
    parts = [chosen] if blocks == 1 else [chosen.where(F.pmod(F.xxhash64("term", "left", "right"), F.lit(2 * blocks)) == b) for b in range(2 * blocks)]
    hits = reduce(DataFrame.unionAll, [near_matches(docs, part, window, near) for part in parts])
    return hits.groupBy("_d", "_t").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("near_ids"))


def _beside(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with the columns of more, if there are any for their key."""
    renamed = more.withColumnsRenamed({"_d": "_md", "_t": "_mt"})
    return rows.join(renamed, rows["_d"].eqNullSafe(renamed["_md"]) & (rows["_t"] == renamed["_mt"]), "left").drop("_md", "_mt")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: float | None = NEAR) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the key _t, and if `near` is given,
    n_near_items: items with proximity matches and no exact ones."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.keep(_items(benchmark), "items")
    terms = items.select(F.explode("words").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id())
    terms = scratch.keep(terms, "terms")
    texts, several = one_of_each(docs.select(*row_key(), "text"), scratch)
    postings = scratch.keep(index(texts, terms), "postings")
    counts = scratch.keep(postings.where("tid >= 0").groupBy("tid").agg(F.count("*").alias("n")), "counts")
    wanted = scratch.keep(windows(items, terms, counts, window), "windows")
    hits = phrases(postings, wanted, scratch).join(wanted.select("wid", "need", "ids"), "wid")
    by_doc = (
        hits.groupBy("_d", "_t")
        .agg(
            F.sort_array(F.collect_set(F.struct(F.col("s").alias("first"), (F.col("s") + F.col("need") - 1).alias("last")))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"),
        )
        .select("_d", "_t", _covered(F.col("spans")).alias("n_hit"), "ids")
    )
    rows = _beside(postings.where("pos = 0").select("_d", "_t", F.col("n").cast("long").alias("n_words")), by_doc)
    rows = _beside(rows, several.select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.sequence(F.lit(1), F.col("n")).alias("copies")))
    rows = rows.withColumn("copy", F.explode(F.coalesce("copies", F.array(F.lit(1).cast("long"))))).drop("copies", "copy")
    none = F.array().cast("array<string>")
    ids, n_hit = F.coalesce("ids", none), F.coalesce("n_hit", F.lit(0).cast("long"))
    out = [
        F.col("_d").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), "_t",
    ]
    if near is not None:
        rows = _beside(rows, _near_ids(docs, items, terms.join(counts, "tid").select("term", "n"), scratch, window, near))
        out.append(F.size(F.array_except(F.coalesce("near_ids", none), ids)).cast("long").alias("n_near_items"))
    return rows.select(*out)
