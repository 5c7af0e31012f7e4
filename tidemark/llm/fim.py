"""Fill-in-middle transformation: each text is cut at two of its unit boundaries and its parts are put in another order.

A batch is one buffer of UTF-8 bytes for all its rows.  A table gives each byte's class; two neighbouring classes tell where a
unit begins; running sums of these marks, counted from each document's base, number the units; and `searchsorted` finds the
cuts of all rows together.  The outputs are gathered from the same buffer, again for all rows at once.  A batch is worked in
stretches of at most AT_ONCE bytes, so that memory is bounded; a longer text is a stretch of its own.

The cuts are drawn from the sha256 of the seed, a colon and the decimal doc_id, so they are the same wherever and however often
a row is worked.  A row depends on no other: nothing is shuffled.

Null texts count as empty.  Texts that are empty, or hold a sentinel, stay plain: output is the text, and lengths of parts are
null.  Texts of any length are worked whole.  A null doc_id counts as an empty one.  Rows of equal doc_id are cut by equal
numbers.  An empty table gives an empty result.  A column that is named like an output is replaced by it; any other passes through.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked at once; a stretch takes some thirty times as much memory.
AT_ONCE = 4_000_000
SENTINELS = ("<P>", "<S>", "<M>")
OUT = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]

#: Classes of bytes: the newline, other blanks of ASCII, bytes that continue a code point, all others.
NEWLINE, BLANK, INNER, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = INNER
CLASS[[9, 11, 12, 13, 32]] = BLANK
CLASS[10] = NEWLINE


def _begins(rule) -> np.ndarray:
    """Whether a unit begins between two neighbouring bytes, by their classes."""
    return np.array([[rule(a, b) for b in range(4)] for a in range(4)])


#: line: up to and with its newline; word: blanks and what follows them up to the next blank; char: a code point.
UNITS = {
    "line": _begins(lambda a, b: a == NEWLINE),
    "word": _begins(lambda a, b: a not in (BLANK, NEWLINE) and b in (BLANK, NEWLINE)),
    "char": _begins(lambda a, b: b != INNER),
}


def _check(sentinels: tuple[str, ...]) -> list[bytes]:
    """The sentinels as bytes, if a text can always be rebuilt from an output with them."""
    marks = [s.encode() for s in sentinels]
    overlap = any(x[k:] == y[: len(x) - k] for x in marks for y in marks for k in range(1, len(x)))
    inside = any(x in y for i, x in enumerate(marks) for j, y in enumerate(marks) if i != j)
    if len(marks) != 3 or not all(marks) or overlap or inside:
        raise ValueError("three sentinels are needed, none of them empty, in another, or overlapping with one")
    return marks


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or of bytes, and the rows' places in them from 0 on; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    held = column.buffers()[2]
    raw = np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _stretches(offsets: np.ndarray, most: int):
    """Runs of rows, (first, last), of at most so many bytes; a longer row alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


def _holding(raw: np.ndarray, offsets: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Which rows hold one of the marks."""
    found = np.zeros(len(offsets) - 1, bool)
    for mark in marks:
        if len(raw) < len(mark):
            continue
        here = np.flatnonzero(raw[: len(raw) - len(mark) + 1] == mark[0])
        for k in range(1, len(mark)):
            here = here[raw[here + k] == mark[k]]
        rows = np.searchsorted(offsets, here, "right") - 1
        found[rows[here + len(mark) <= offsets[rows + 1]]] = True
    return found


def cut(raw: np.ndarray, offsets: np.ndarray, h: np.ndarray, marks: list[bytes], begins: np.ndarray, rate: int, spm: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of the rows whose texts stand in raw; h has four numbers a row."""
    rows, size = len(offsets) - 1, len(raw)
    start, end = offsets[:-1], offsets[1:]
    kinds = CLASS[raw]
    first = np.zeros(size, bool)
    first[1:] = begins[kinds[:-1], kinds[1:]]
    first[start[start < end]] = True
    units, chars = np.cumsum(first, dtype=np.int32), np.cumsum(kinds != INNER, dtype=np.int32)
    before = lambda sums, at: np.where(at > 0, sums[np.maximum(at, 1) - 1], 0) if size else np.zeros(len(at), np.int32)  # noqa: E731  sums of all that stands left of a place
    base = before(units, start).astype(np.int64)
    n = before(units, end) - base
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    places = [np.where(k < n, np.searchsorted(units, (base + k + 1).astype(np.int32)), end) for k in (np.minimum(a, b), np.maximum(a, b))]
    plain = (start == end) | _holding(raw, offsets, marks) | (h[:, 2] % 100 >= rate)
    spm_form = ~plain & (h[:, 3] % 100 < spm)

    # each output is six pieces of one buffer, the marks standing at its end; a plain one has its text as the second
    whole = np.concatenate([raw, *[np.frombuffer(x, np.uint8) for x in marks]])
    mark = np.r_[size, size + len(marks[0]), size + len(marks[0]) + len(marks[1]), len(whole)]
    prefix, middle, suffix = (start, places[0]), (places[0], places[1]), (places[1], end)
    p, s, m = ((mark[k], mark[k + 1]) for k in range(3))
    pick = lambda psm, spm_: tuple(np.where(spm_form, y, x) for x, y in zip(psm, spm_, strict=True))
    pieces = [pick(p, s), pick(prefix, suffix), pick(s, p), pick(suffix, prefix), pick(m, m), pick(middle, middle)]
    begin, length = np.stack([x for x, _ in pieces], 1).astype(np.int64), np.stack([y - x for x, y in pieces], 1).astype(np.int64)
    begin[plain, 1], length[plain] = start[plain], 0
    length[plain, 1] = (end - start)[plain]
    begin, length = begin.ravel(), length.ravel()
    upto = np.cumsum(length)
    total = int(upto[-1]) if rows else 0
    kind = np.int32 if max(total, len(whole)) < 2**31 else np.int64
    out = whole[np.repeat((begin - (upto - length)).astype(kind), length) + np.arange(total, dtype=kind)]
    ends = np.r_[0, upto.reshape(rows, 6)[:, -1]] if rows else np.zeros(1, np.int64)
    lengths = [before(chars, y).astype(np.int64) - before(chars, x) for x, y in (prefix, middle)]
    form = pa.array(np.where(plain, "plain", np.where(spm_form, "spm", "psm")).tolist(), pa.string())
    texts = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
    return [pa.array(n.astype(np.int64)), form, *[pa.array(x, mask=plain) for x in lengths], texts]


def _draws(doc_id: str, seed: str) -> list[Column]:
    """Four numbers of 32 bits for each row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _worked(batches, marks: list[bytes], begins: np.ndarray, rate: int, spm: int, most: int):
    for batch in batches:
        raw, offsets = _flat(batch.column(1))
        h = np.stack([batch.column(k).to_numpy() for k in range(2, 6)], 1)
        for first, last in _stretches(offsets, most):
            mine = offsets[first : last + 1]
            made = cut(raw[mine[0] : mine[-1]], mine - mine[0], h[first:last], marks, begins, rate, spm)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *made], names=["row", *[f.name for f in OUT]])


def fill_in_middle(docs: DataFrame, seed: str = "7", unit: str = "line", rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points) and output.

    rate: of a hundred texts, how many are cut; spm: of a hundred that are cut, how many have the suffix first.
    psm is prefix, suffix, middle and spm suffix, prefix, middle, each after its sentinel (of prefix, suffix, middle)."""
    names = {f.name for f in OUT}
    marks = _check(sentinels)
    kept = [c for c in docs.columns if c.lower() not in names and (keep_text or c != text)]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(True).alias("none"))
    h = [x.alias(f"h{k}") for k, x in enumerate(_draws(doc_id, seed))]
    fed = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"), *h)
    schema = T.StructType([fed.schema["row"], *OUT])
    made = fed.mapInArrow(partial(_worked, marks=marks, begins=UNITS[unit], rate=rate, spm=spm, most=AT_ONCE), schema)
    return made.select(*[F.col("row")[c].alias(c) for c in kept], *[f.name for f in OUT])


def restored(form: str = "form", output: str = "output", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of, rebuilt from the output and its form alone."""
    _check(sentinels)
    parts = F.split(F.col(output), "|".join(map(re.escape, sentinels)), -1)
    joined = F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(joined)
