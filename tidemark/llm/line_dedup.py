"""Line dedup by a suffix array over line-ID sequences.

A line's ID is a 128-bit hash.  A line that occurs once ends every repeated run, so documents fall into segments of
repeated lines between such lines.  Equal segments are told apart only by place: a later one is a later copy as a whole,
and only the first of each is sorted.

Prefix doubling, distributed: positions are ranked by their line, then by the ranks of the positions 1, 2, 4, ... lines on,
until the longest segment is passed.  A round groups positions by a pair of ranks (map-side first), range-sorts the
groups, numbers them in order, and joins the numbers back.  The last ranks give the suffix array.  Longest common prefixes
of neighbours follow from the ranks of all rounds, from the longest power of two to the shortest.

LCP intervals: in suffix order, neighbours merge from the longest common prefix to the shortest; in each interval the
earliest place lives on, and every other learns the longest run that starts there and also starts at an earlier place.
Stretches of the array are merged apart, with a stack, and what reaches over their ends is merged again, so no task
sees the whole.  Every run of at least MIN_WORDS words that also starts earlier is a later copy, and its lines go.

Order is by doc_id (nulls first; whole numbers as such, others as text), then by the text's hash, then by place.  Rows with the same doc_id and text are one
document and get equal results.  Words are what stands between spaces or tabs; scripts that write no spaces count a word for
each two Han or kana characters in a row, or four of Thai and the like (SEVERAL), so that runs of them are measured too.  Lines are split at "\\n" and compared exactly; empty lines count no words but can stand
within a run.  Null and empty texts stay as they are; a text of any length is one row of lines.  A text of only later copies becomes empty.  An empty table gives
an empty result.  Extra columns pass through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, one_of_each, row_key, whole_rows

MIN_WORDS = 10
#: Places in a stretch of the suffix array, from the second merge on.
STRETCH = 200_000

#: Scripts without spaces between words, and how many characters in a row count as a word at most.
SEVERAL = {2: r"[\p{IsHan}\p{IsBopomofo}\p{IsYi}\p{IsHiragana}\p{IsKatakana}ー]", 4: r"[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"}


def line_words(line: Column, cut: bool = True) -> Column:
    """Words between spaces or tabs, and if `cut`, in scripts that write no spaces, stretches of characters."""
    for n, kind in SEVERAL.items() if cut else ():
        line = F.regexp_replace(line, f"{kind}{{1,{n}}}", " x ")
    return F.size(F.array_remove(F.split(F.replace(line, F.lit("\t"), F.lit(" ")), " ", -1), ""))


def _lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, t, p, h1, h2, w): all lines of each document, with two hashes and the number of words."""
    # all scripts that need cutting are from U+0E00 on; most texts have nothing there
    plain = F.when(F.length("text") == F.octet_length("text"), True).otherwise(~F.col("text").rlike(r"[^\x00-\u0DFF]"))
    texts = docs.where(F.length("text") > 0).select(*row_key(), "text", plain.alias("plain"))
    once, _ = one_of_each(texts, scratch)
    lines = once.select(F.col("_d").alias("d"), F.col("_t").alias("t"), "plain", F.posexplode(F.split("text", "\n", -1)).alias("p", "x"))
    words = F.when(F.col("plain"), line_words(F.col("x"), False)).otherwise(line_words(F.col("x"), True))
    return lines.select("d", "t", "p", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(11), "x").alias("h2"), words.alias("w"))


def _segments(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, t, p, lines): maximal stretches of lines that occur elsewhere, with the place of the first line."""
    # written, as Spark splits the rows of a common line only if the join reads both sides from exchanges of its own
    repeated = scratch.keep(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeated")
    by_doc = lines.join(repeated, ["h1", "h2"]).groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("p", "h1", "h2", "w"))).alias("a"))
    begins = F.filter(F.sequence(F.lit(0), F.size("a") - 1), lambda k: (k == 0) | (F.get("a", k - 1)["p"] != F.get("a", k)["p"] - 1))
    cut = by_doc.withColumn("at", begins).select("d", "t", "a", "at", F.posexplode("at").alias("k", "from"))
    part = F.slice("a", F.col("from") + 1, F.coalesce(F.get("at", F.col("k") + 1), F.size("a")) - F.col("from"))
    return cut.select("d", "t", part.alias("a")).select("d", "t", F.col("a")[0]["p"].alias("p"), F.transform("a", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["w"].alias("w"))).alias("lines"))


def _numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys with a number that rises in their order."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys).orderBy(*keys).withColumn("r", F.monotonically_increasing_id())


def suffix_ranks(places: DataFrame, longest: int, scratch: Scratch) -> list[DataFrame]:
    """places: (sid, o, h1, h2), the o-th line of segment sid.  For k = 1, 2, 4, ... the ranks (sid, o, r) of all places by
    their next k lines, or by all that are left.  It ends where all ranks differ, as longer stretches are in the same order."""
    names = scratch.keep(_numbered(places, ["h1", "h2"]), "names-0")
    ranks = [scratch.keep(places.join(names, ["h1", "h2"]).select("sid", "o", "r"), "ranks-0")]
    n_places, k = ranks[0].count(), 1
    while k < longest and names.count() < n_places:
        n, last = len(ranks), ranks[-1]
        on = last.select("sid", (F.col("o") - k).alias("o"), F.col("r").alias("r2"))
        both = scratch.keep(last.withColumnRenamed("r", "r1").join(on, ["sid", "o"], "left").select("sid", "o", "r1", F.coalesce("r2", F.lit(-1)).alias("r2")), f"pairs-{n}")
        names = scratch.keep(_numbered(both, ["r1", "r2"]), f"names-{n}")
        ranks.append(scratch.keep(both.join(names, ["r1", "r2"]).select("sid", "o", "r"), f"ranks-{n}"))
        scratch.drop(f"pairs-{n}", f"names-{n - 1}")
        k *= 2
    return ranks


def _beside(batches):
    """Rows in suffix order, each with the place before it; the first of a partition has none."""
    sid = o = None
    for batch in batches:
        s, p = batch.column("sid").to_pylist(), batch.column("o").to_pylist()
        if s:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sid, *s[:-1]], pa.int64()), pa.array([o, *p[:-1]], pa.int32())], names=[*batch.schema.names, "psid", "po"])
            sid, o = s[-1], p[-1]


def suffix_array(ranks: list[DataFrame], segments: DataFrame, scratch: Scratch) -> DataFrame:
    """(idx, sid, o, d, t, p, lcp): all places in suffix order, with the lines that each shares with the one before it."""
    info = segments.select("sid", "d", "t", F.col("p").alias("p0"), F.size("lines").alias("n"))
    rows = ranks[-1].join(info, "sid").select("r", "d", "t", (F.col("p0") + F.col("o")).alias("p"), "sid", "o", (F.col("n") - F.col("o")).alias("rest"))
    rows = rows.orderBy("r", "d", "t", "p").withColumn("idx", F.monotonically_increasing_id())
    rows = scratch.keep(rows.mapInArrow(_beside, ", ".join(f"{a} {b}" for a, b in rows.dtypes) + ", psid long, po int"), "beside")
    ends = rows.groupBy(F.shiftright("idx", 33).alias("part")).agg(F.max_by(F.struct("sid", "o"), "idx").alias("x")).orderBy("part").collect()  # a row for each partition
    before = [(b["part"], a["x"]["sid"], a["x"]["o"]) for a, b in zip(ends, ends[1:], strict=False)]
    before = scratch.spark.createDataFrame(before, "part long, bsid long, bo int")
    rows = rows.join(F.broadcast(before), F.shiftright("idx", 33) == F.col("part"), "left")
    rows = rows.select("idx", "sid", "o", "d", "t", "p", "rest", F.coalesce("psid", "bsid").alias("psid"), F.coalesce("po", "bo").alias("po"), F.lit(0).alias("lcp"))
    for k, level in enumerate(reversed(range(len(ranks)))):
        mine = ranks[level].select("sid", F.col("o").alias("at"), F.col("r").alias("ra"))
        theirs = ranks[level].select(F.col("sid").alias("psid"), F.col("o").alias("pat"), F.col("r").alias("rb"))
        rows = rows.withColumns({"at": F.col("o") + F.col("lcp"), "pat": F.col("po") + F.col("lcp")})
        rows = rows.join(mine, ["sid", "at"], "left").join(theirs, ["psid", "pat"], "left").drop("at", "pat")
        rows = rows.withColumn("lcp", F.col("lcp") + F.when(F.col("ra") == F.col("rb"), F.least(F.lit(1 << level), F.col("rest") - F.col("lcp"))).otherwise(0)).drop("ra", "rb")
        if k % 3 == 2 and level:  # short plans: the driver holds and plans all joins of one at once
            rows = scratch.keep(rows, f"lcp-{level}")
            scratch.drop(*(x for x in list(scratch.paths) if x == "beside" or x.startswith("lcp-") and x != f"lcp-{level}"))
    return scratch.keep(rows.select("idx", "sid", "d", "t", "p", "lcp"), "suffixes")


def _merger(last: bool, kind: pa.DataType):
    none = 0 if pa.types.is_integer(kind) else ""

    def run(batches):
        """Rows (idx, sid, d, t, p, lcp) in order.  Out go rows whose run is known (done: lcp is its length) and those that may
        still merge with what is outside; of those, idx and lcp say where they stand."""
        out: list[tuple] = []
        stack: list[list] = []  # [idx, lines shared with the one before, place]; shared lines rise, but for the lowest

        def close(shared: int) -> None:
            """Merge what shares at least so many lines; to the right, so many are shared with what comes next."""
            while len(stack) > 1 and stack[-1][1] >= shared:
                a, b = stack[-2:]
                if a[1] > b[1]:  # the lowest one, which merges with what is outside first
                    out.append((False, a[0], a[1], a[2]))
                    del stack[0]
                    continue
                win, lose = (a, b) if a[2] < b[2] else (b, a)
                out.append((True, lose[0], b[1], lose[2]))
                a[2] = win[2]
                stack.pop()
            if shared == 0 and stack:
                a = stack.pop()
                if a[1] > 0 and not last:
                    out.append((False, a[0], a[1], a[2]))

        def flush():
            cols = list(zip(*[(done, idx, place[4], place[1] if place[0] else None, place[2], place[3], lcp) for done, idx, lcp, place in out], strict=True)) or [[]] * 7
            kinds = [pa.bool_(), pa.int64(), pa.int64(), kind, pa.int64(), pa.int32(), pa.int32()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["done", "idx", "sid", "d", "t", "p", "lcp"])

        for batch in batches:
            for idx, sid, d, t, p, lcp in zip(*(batch.column(c).to_pylist() for c in ("idx", "sid", "d", "t", "p", "lcp")), strict=True):
                close(lcp)
                stack.append([idx, lcp, (d is not None, none if d is None else d, t, p, sid)])
            yield flush()
        if last:
            close(0)
        out.extend((False, a[0], a[1], a[2]) for a in stack)
        yield flush()

    return run


def earlier_runs(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, p, lcp): for each place, the lines of the longest run from there that also starts at an earlier place; none if 0."""
    d = dict(suffixes.dtypes)["d"]
    schema = f"done boolean, idx long, sid long, d {d}, t long, p int, lcp int"
    found, rest, n, k, stretch = [], suffixes, suffixes.count(), 0, STRETCH
    while True:
        last = n <= stretch
        dealt = rest.repartition(1) if last else rest.repartitionByRange(max(2, -(-n // stretch)), "idx")
        merged = scratch.keep(dealt.sortWithinPartitions("idx").mapInArrow(_merger(last, _ARROW[d]), schema), f"merged-{k}")
        found.append(merged.where("done").select("sid", "p", "lcp"))
        rest, k = merged.where("not done").drop("done"), k + 1
        if last:
            break
        before, n = n, rest.count()
        # as where one line repeats and lcp only rises.  A stretch leaves at most twice as many rows as the longest segment has
        # lines, so stretches end at about four times that: a task never holds more than a few times the longest text's lines
        if 2 * n > before:
            stretch *= 2
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _small(batches):
    """Batches of at most 512 rows, as rows hold lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield batch.slice(at, 512)


def _spans(min_words: int, kind: pa.DataType):
    def run(batches):
        for batch in _small(batches):
            rows = []
            for d, t, p0, words, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = [0]
                for w in words:
                    total.append(total[-1] + w)
                end = -1
                for p, n in sorted((x["p"] - p0, x["lcp"]) for x in runs):
                    if p + n > end and total[p + n] - total[p] >= min_words:
                        rows.append((d, t, p0 + max(p, end), p0 + p + n))
                        end = p + n
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["d", "t", "a", "b"])

    return run


def _masks(batches):
    for batch in _small(batches):
        masks = []
        for spans in batch.column(2).to_pylist():
            mask = [False] * max(x["b"] for x in spans)
            for x in spans:
                mask[x["a"] : x["b"]] = [True] * (x["b"] - x["a"])
            masks.append(mask)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.list_(pa.bool_()))], names=["d", "t", "mask"])


#: Kinds of doc_id: whole numbers are compared as such, all else as text.
_ARROW = {"bigint": pa.int64(), "string": pa.string()}


def _id_kind(docs: DataFrame) -> str:
    return "bigint" if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint") else "string"


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, mask): for each document with later copies, which of its lines are in one."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    d = _id_kind(docs)
    segments = _segments(scratch.keep(_lines(docs.select(F.col("doc_id").cast(d).alias("doc_id"), "text"), scratch), "lines"), scratch)
    segments = scratch.keep(segments.select(F.monotonically_increasing_id().alias("sid"), "*", F.xxhash64("lines").alias("g1"), F.xxhash64(F.lit(11), "lines").alias("g2")), "segments")
    scratch.drop("lines", "repeated")
    # written, as Spark splits the rows of a common segment only if the join reads both sides from exchanges of its own
    first = scratch.keep(segments.groupBy("g1", "g2").agg(F.min(F.struct("d", "t", "p")).alias("f")), "first")
    marked = segments.join(first, ["g1", "g2"])
    is_first = F.col("d").eqNullSafe(F.col("f.d")) & (F.col("t") == F.col("f.t")) & (F.col("p") == F.col("f.p"))
    marked = scratch.keep(marked.select("sid", "d", "t", "p", "lines", is_first.alias("first")), "marked")
    scratch.drop("segments", "first")
    later = marked.where(~F.col("first") & (F.aggregate("lines", F.lit(0), lambda n, x: n + x["w"]) >= min_words)).select("d", "t", F.col("p").alias("a"), (F.col("p") + F.size("lines")).alias("b"))
    firsts = marked.where("first")
    longest = firsts.agg(F.max(F.size("lines"))).first()[0] or 0
    places = firsts.select("sid", F.posexplode("lines").alias("o", "x")).select("sid", "o", "x.h1", "x.h2")
    runs = earlier_runs(suffix_array(suffix_ranks(places, longest, scratch), firsts, scratch), scratch).where("lcp > 0")
    by_segment = runs.groupBy("sid").agg(F.collect_list(F.struct("p", "lcp")).alias("runs"))
    within = firsts.join(by_segment, "sid").select("d", "t", "p", F.transform("lines", lambda x: x["w"]).alias("words"), "runs").mapInArrow(_spans(min_words, _ARROW[d]), f"d {d}, t long, a int, b int")
    spans = later.union(within).groupBy("d", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    masks = scratch.keep(spans.mapInArrow(_masks, f"d {d}, t long, mask array<boolean>"), "masks")
    scratch.drop(*(x for x in scratch.paths if x != "masks"))
    return masks


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines of later copies gone from `text`, and with n_lines (before) and n_removed."""
    masks = later_copies(docs, min_words)
    keyed, text = whole_rows(docs.drop("n_lines", "n_removed")), F.col("_row.text")
    joined = keyed.join(masks, keyed["_d"].cast(_id_kind(docs)).eqNullSafe(masks["d"]) & (keyed["_t"] == masks["t"]), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, k: ~F.coalesce(F.get("mask", k), F.lit(False))), "\n")
    removed = F.coalesce(F.size(F.filter("mask", lambda x: x)), F.lit(0)).cast("long")
    n_lines = F.when(F.length(text) > 0, F.size(lines)).otherwise(0).cast("long")
    columns = [F.when(F.col("mask").isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, n_lines.alias("n_lines"), removed.alias("n_removed"))
