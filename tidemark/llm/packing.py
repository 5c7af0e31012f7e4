"""Best-fit packing of documents' ids into sequences of a fixed size.

1. Texts become ids in tasks; those longer than a sequence are cut into pieces.  The pieces' lengths are counted: the histogram
   has at most one row a possible length, whatever the corpus, and only it goes to the driver.
2. Configuration linear program over the histogram: a configuration says how many pieces of each group of lengths a sequence
   takes, and the least number of sequences that covers all groups is sought.  It is solved by multiplicative weights: each
   group has a price that falls as it is covered; the configuration worth most at these prices is found by a dynamic program (a
   knapsack with as many copies as there are) and taken more often.  Prices also give a lower bound, by which the rounds end.
3. Rounding: configurations are taken whole numbers of times, with exact lengths in place of groups: a group's piece is the
   longest left of it, and the last piece the longest left that fits.  What remains goes where it fits best, longest first, or into new
   sequences.  All of this is on counts of equal sequences, so its size depends on the number of lengths and not on the corpus.
4. Each piece gets its number among those of its length, by counts over salted groups and sums of these, so no length is a hot key.
   The number tells its sequence and its place there; what tells it is broadcast, and bounded like the histogram.

Null texts count as empty: their only id is the end.  Texts of any length are worked whole.  Rows of equal doc_id, and repeated
rows, are packed each for itself.  A null doc_id is a value like others.  Other columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import is_latin, latin
from tidemark.llm.common import Scratch
from tidemark.llm.fim import _flat, _stretches

CAPACITY = 4_096
#: Groups of lengths in the linear program, and the share of a sequence up to which a piece is too short for it and only fills.
GROUPS, SHORT = 96, 1 / 64
#: Step of prices, rounds at most, and the gap to the lower bound at which rounds end.
STEP, ROUNDS, GAP = 0.1, 3_000, 0.002
#: Bytes of words and ids that a worker remembers, bytes of text at once, bytes of ids in a batch, rows of one length that are numbered together.
REMEMBERED, AT_ONCE, SENT_AT_ONCE, TOGETHER = 32_000_000, 4_000_000, 8_000_000, 1_000

#: A character that stands between stretches told to the library, which makes one id of it that nothing else has; stretches told at once,
#: and words given to its model at once.
MARK, TOLD_AT_ONCE, MODELLED_AT_ONCE = "\x01", 2_000, 200
#: Blanks of Unicode; what Python's split takes for blanks besides, U+001C to U+001F, are none.
_APART = re.compile("[^\t\n\v\f\r \x85\xa0  -     　]+")


# --- ids ---------------------------------------------------------------------------------------------------------------------


#: Steps before the model that are plain for stretches of Latin-1 without blanks: the first two change nothing there, and bytes become characters.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The character of each byte, as UTF-32.
_CHARACTERS = np.arange(256, dtype="<u4")
_CHARACTERS[sorted({*range(256)} - _SHOWN)] = 256 + np.arange(256 - len(_SHOWN))


def _words(made: dict) -> re.Pattern | None:
    """What cuts lower-cased stretches of Latin-1, a line each, into the words that the model gets and the lines' ends; None if
    the tokenizer has other steps than those above, or if its model does not mark the last token of each word."""
    steps, model = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}], made["model"]
    cut = {"type": "Split", "pattern": steps[0].get("pattern"), "behavior": "Removed", "invert": True}
    plain = made.get("normalizer") == _NORMALIZER and steps == [cut, _BYTES] and not made.get("truncation") and not made.get("padding") and all(x["special"] for x in made["added_tokens"])
    marked = model.get("type") == "BPE" and (suffix := model.get("end_of_word_suffix")) and all(chr(c) + suffix in model["vocab"] for c in _CHARACTERS)
    found = latin(steps[0]["pattern"].get("Regex", "\\")) if plain and marked else None
    return found and re.compile(rf"{found.pattern}|\n")


class Encoder:
    """Ids of texts, four bytes each.  apart: the tokenizer drops blanks and never joins what stands on both sides of one, so
    the stretches between blanks are looked up, and only new ones are given to the library.  Where its steps before the model
    are known, stretches of Latin-1 are cut into words, and only the library's model is asked, once for a word."""

    def __init__(self, made: str, apart: bool, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for every core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(made)
        self.library.encode_special_tokens = special_as_text
        self.apart, self.known, self.parts, self.held = apart, {}, {"\n": b""}, 0
        spec = json.loads(made)
        self.model, self.find = Tokenizer(self.library.model), _words(spec) if apart and special_as_text else None
        if self.find:
            vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[k for x, k in vocab.items() if x.endswith(suffix)]] = True
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, some: list[str]) -> dict[str, bytes]:
        """The ids of stretches without blanks."""
        mine = [x for x in some if is_latin(x)] if self.find else []
        others = list(set(some).difference(mine)) if len(mine) < len(some) else []
        made = dict(zip(others, self._told(others), strict=True))
        words = self.find.findall("\n".join([*mine, ""]).lower()) if mine else []
        new = list(set(words).difference(self.parts))
        for x, ids in zip(new, self._modelled(new), strict=True):
            self.parts[x] = ids
            self.held += len(x) + len(ids)
        parts = list(map(self.parts.__getitem__, words))
        sizes, whole = np.fromiter(map(len, parts), np.int64, len(parts)), b"".join(parts)
        ends = np.cumsum(sizes)[sizes == 0].tolist()  # only a line's end has no ids
        return made | {x: whole[a:b] for x, a, b in zip(mine, [0, *ends][: len(mine)], ends, strict=True)}

    def _modelled(self, words: list[str]) -> list[bytes]:
        """The ids of lower-cased words of Latin-1, from the model alone."""
        out = []
        for first in range(0, len(words), MODELLED_AT_ONCE):
            mine = words[first : first + MODELLED_AT_ONCE]
            shown = _CHARACTERS[np.frombuffer("\n".join(mine).encode(), np.uint8)].tobytes().decode("utf-32-le").split(chr(_CHARACTERS[10]))
            ids = np.array(self.model.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(mine):
                whole = ids.tobytes()
                out += [whole[a:b] for a, b in zip([0, *(4 * ends[:-1]).tolist()], (4 * ends).tolist(), strict=True)]
            else:  # a token within a word is named like a last one
                out += [np.array([token.id for token in self.model.model.tokenize(x)], "<u4").tobytes() for x in shown]
        return out

    def _told(self, some: list[str]) -> list[bytes]:
        """The ids of stretches without blanks: many are given to the library at once, with MARK between them."""
        if self.mark is None or any(MARK in x for x in some):
            return self._encoded(some)
        out = []
        for first in range(0, len(some), TOLD_AT_ONCE):
            mine = some[first : first + TOLD_AT_ONCE]
            ids = np.array(self.library.encode_batch_fast([f" {MARK} ".join(mine)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark) * 4
            whole = ids.tobytes()
            out += [whole[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(whole)], strict=True)]
        return out

    def __call__(self, texts: list[str], odd: bool) -> list[bytes]:
        """odd: whether there are characters that Python's split wrongly takes for blanks."""
        if not self.apart:
            return self._encoded(texts)
        lists = [_APART.findall(x) if odd else x.split() for x in texts]
        here = set().union(*lists)
        if self.held > REMEMBERED:
            self.known, self.parts = {x: self.known[x] for x in here if x in self.known}, {"\n": b""}
            self.held = sum(len(x) + len(y) for x, y in self.known.items())
        new = list(here.difference(self.known))
        for x, ids in self._apart(new).items():
            self.known[x] = ids
            self.held += len(x) + len(ids)
        return [b"".join(map(self.known.__getitem__, x)) for x in lists]


_encoders: dict[tuple, Encoder] = {}


def _encoder(held, apart: bool, special_as_text: bool) -> Encoder:
    """One for a worker, which outlives its tasks."""
    key = (held.id if hasattr(held, "id") else id(held), apart, special_as_text)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(held.value, apart, special_as_text)
    return _encoders[key]


def _cut(batches, held, apart: bool, special_as_text: bool, end: int, capacity: int, ids: bool):
    encoder, last_id = _encoder(held, apart, special_as_text), np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def made(rows, column):
        at, piece, start, parts = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
        length = [len(x) // 4 for x in parts]
        out = [column.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(map(zlib.crc32, parts), pa.int64())]
        if ids:
            joined = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(joined)))
        return pa.RecordBatch.from_arrays(out, names=names)

    for batch in batches:
        raw, offsets = _flat(batch.column(1))
        for first, last in _stretches(offsets, AT_ONCE):
            here = raw[offsets[first] : offsets[last]]
            texts = [x or "" for x in batch.column(1).slice(first, last - first).to_pylist()]
            rows, size = [], 0
            for k, whole in enumerate(encoder(texts, bool(((here >= 0x1C) & (here <= 0x1F)).any()))):
                whole += last_id
                for piece, x in enumerate(range(0, len(whole), 4 * capacity)):
                    rows.append((first + k, piece, x // 4, whole[x : x + 4 * capacity]))
                size += len(whole)
                if size > SENT_AT_ONCE:
                    yield made(rows, batch.column(0))
                    rows, size = [], 0
            yield made(rows, batch.column(0))


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, apart: bool = False, special_as_text: bool = True, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids if asked for): each text's ids and the end, cut where a sequence is full.

    tokenizer: the path of a tokenizer's file.  special_as_text: strings of special tokens in a text are ordinary text."""
    with open(tokenizer, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    fed = docs.select("doc_id", "text")
    more = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([fed.schema["doc_id"], *more, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids])
    return fed.mapInArrow(partial(_cut, held=held, apart=apart, special_as_text=special_as_text, end=end, capacity=capacity, ids=ids), schema)


# --- the plan ----------------------------------------------------------------------------------------------------------------


def least(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A number of sequences that no packing can go below: by the sum, and by pieces that can't stand together."""
    most = 0
    for k in {0, *(x for x in counts if 2 * x <= capacity)}:
        large = sum(n for x, n in counts.items() if x > capacity - k)
        middle = sum(n for x, n in counts.items() if 2 * x > capacity and x <= capacity - k)
        room = middle * capacity - sum(n * x for x, n in counts.items() if 2 * x > capacity and x <= capacity - k)
        small = sum(n * x for x, n in counts.items() if k <= x and 2 * x <= capacity)
        most = max(most, large + middle + max(0, -(-(small - room) // capacity)))
    return most


def grouped(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, int]]:
    """(longest, number) of the groups of lengths for the linear program, of about equal sums; short lengths are in none."""
    lengths = sorted((x for x in counts if SHORT * capacity < x < capacity), reverse=True)
    share = sum(x * counts[x] for x in lengths) / groups
    out, top, number, held = [], 0, 0, 0
    for x in lengths:
        top, number, held = top or x, number + counts[x], held + x * counts[x]
        if held >= share:
            out.append((top, number))
            top, number, held = 0, 0, 0
    return out + [(top, number)] * (number > 0)


def knapsack(worth: np.ndarray, size: np.ndarray, copies: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each kind are worth most together, within the capacity and the copies there are."""
    parts = []
    for kind, (x, n) in enumerate(zip(size.tolist(), np.minimum(copies, capacity // size).tolist(), strict=True)):
        k = 1
        while n > 0:
            parts.append((kind, min(k, n), min(k, n) * x))
            n, k = n - k, 2 * k
    best, taken = np.zeros(capacity + 1), np.zeros((len(parts), capacity + 1), bool)
    for row, (kind, k, x) in enumerate(parts):
        more = best[: capacity + 1 - x] + k * worth[kind]
        np.greater(more, best[x:], out=taken[row, x:])
        best[x:] = np.maximum(best[x:], more)
    out, left = np.zeros(len(size), np.int64), capacity
    for row in range(len(parts) - 1, -1, -1):
        if taken[row, left]:
            kind, k, x = parts[row]
            out[kind] += k
            left -= x
    return out


def configurations(groups: list[tuple[int, int]], capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> tuple[dict[tuple[int, ...], float], float]:
    """The linear program: how often each configuration (pieces of each group) is taken, and a lower bound of the sum."""
    size, number = (np.array(x, np.int64) for x in zip(*groups, strict=True))
    taken: dict[tuple[int, ...], float] = {}
    covered, used, bound = np.zeros(len(groups)), 0.0, 0.0
    for _ in range(rounds):
        prices = np.exp(-STEP * (covered - covered.min())) / number
        some = knapsack(prices, size, number, capacity)
        bound = max(bound, float(prices @ number) / float(prices @ some))
        often = float(np.min(number[some > 0] / some[some > 0]))
        taken[tuple(some.tolist())] = taken.get(tuple(some.tolist()), 0.0) + often
        covered += often * some / number
        used += often
        if covered.min() > 0 and used / covered.min() <= (1 + gap) * bound:
            break
    return {c: x / covered.max() for c, x in taken.items()}, bound


class _Left:
    """Counts of the pieces not placed yet."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for x, n in counts.items():
            self.n[x] = n
        self.below = self._below()

    def _below(self) -> np.ndarray:
        """The longest length up to each one that is there; 0 if there is none."""
        return np.maximum.accumulate(np.where(self.n > 0, np.arange(len(self.n)), 0))

    def take(self, some: Counter, times: int) -> None:
        for x, k in some.items():
            self.n[x] -= k * times
        if any(self.n[x] == 0 for x in some):
            self.below = self._below()

    def longest(self, most: int, some: Counter) -> int:
        """The longest that fits and is there besides some; 0 if there is none."""
        x = int(self.below[most])
        while x and self.n[x] <= some[x]:
            x = int(self.below[x - 1])
        return x


    def closing(self, above: int, most: int, room: int, some: Counter) -> int:
        """Of the lengths above one and up to another, the one beside which the longest that still fits leaves least room."""
        x = np.arange(most, above, -1)
        x = x[self.n[x] > np.array([some[y] for y in x.tolist()], np.int64)] if some else x[self.n[x] > 0]
        if not len(x):
            return self.longest(most, some)
        rest = room - x
        return int(x[np.argmin(rest - self.below[rest])])


def packed(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how many, lengths): sequences that take all pieces, equal ones together."""
    left, out = _Left(counts, capacity), []

    def emit(some: list[int], most: int) -> int:
        held = Counter(some)
        times = min(most, *(int(left.n[x]) // k for x, k in held.items()))
        left.take(held, times)
        out.append((times, some))
        return times

    if counts.get(capacity):
        emit([capacity], counts[capacity])
    groups = grouped(counts, capacity)
    found = configurations(groups, capacity)[0] if groups else {}
    for config, x in sorted(found.items(), reverse=True):  # longest pieces first
        slots = [g for g, k in enumerate(config) for _ in range(k)]
        times = math.floor(x)
        while times > 0:
            some, held, room = [], Counter(), capacity
            for g in slots[:-1]:
                top = min(groups[g][0], room)
                x = left.closing(groups[g + 1][0] if g + 1 < len(groups) else 0, top, room, held) if len(some) == len(slots) - 2 else left.longest(top, held)
                if not x:
                    break
                some.append(x)
                held[x] += 1
                room -= x
            last = left.longest(room, held)
            if len(some) < len(slots) - 1 or not last:  # the groups are used up
                break
            times -= emit([*some, last], times)
    return _best_fit(out, left, capacity)


def _best_fit(out: list[tuple[int, list[int]]], left: _Left, capacity: int) -> list[tuple[int, list[int]]]:
    """out and the pieces left, longest first, each where it leaves least room."""
    by_room: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, bool)

    def put(times: int, some: list[int]) -> None:
        room = capacity - sum(some)
        by_room[room].append((times, some))
        rooms[room] = True

    for x in out:
        put(*x)
    for x in range(capacity, 0, -1):
        n = int(left.n[x])
        while n > 0:
            fits = np.flatnonzero(rooms[x:])
            if len(fits):
                room = x + int(fits[0])
                times, some = by_room[room].pop()
                rooms[room] = bool(by_room[room])
                each = min(room // x, n)
                whole = min(times, n // each)
                put(whole, some + [x] * each)
                if whole < times:
                    put(times - whole, some)
                n -= whole * each
            else:
                each = min(capacity // x, n)
                put(n // each, [x] * each)
                n -= n // each * each
    return [x for held in by_room for x in held]


# --- places ------------------------------------------------------------------------------------------------------------------


class Places:
    """For the pieces of each length, numbered from 0: their sequence and place.  Sorted by length and number."""

    def __init__(self, sequences: list[tuple[int, list[int]]]):
        rows, base, number = [], 0, Counter()
        for times, some in sequences:
            at = 0
            for x, k in sorted(Counter(some).items(), reverse=True):
                rows.append((x, number[x], base, at, k))
                number[x] += k * times
                at += x * k
            base += times
        self.total = base
        rows.sort()
        self.length, self.first, self.base, self.at, self.each = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 5
        self.begin = np.searchsorted(self.length, np.arange((int(self.length[-1]) if rows else 0) + 2))

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(length, kind="stable")
        row = np.empty(len(length), np.int64)
        for mine in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(mine):
                a, b = self.begin[length[mine[0]]], self.begin[length[mine[0]] + 1]
                row[mine] = a + np.searchsorted(self.first[a:b], number[mine], "right") - 1
        k = number - self.first[row]
        return self.base[row] + k // self.each[row], self.at[row] + self.length[row] * (k % self.each[row])


def _placed(batches, places):
    for batch in batches:
        sequence, offset = places.value(batch.column("length").to_numpy(), batch.column("number").to_numpy())
        kept = [c for c in batch.schema.names if c != "number"]
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])


def numbered(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """cut with `number`: from 0 on among the pieces of a length.  Salted groups of about TOGETHER are numbered apart."""
    salts = max(1, -(-max(counts.values(), default=0) // TOGETHER))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    here = W.partitionBy("length", "salt")
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    sums = sums.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("place", F.row_number().over(here.orderBy("doc_id", "piece", "ids_crc32")))
    return ranked.join(sums, ["length", "salt"]).withColumn("number", F.col("before") + F.col("place") - 1).select(*cut.columns, "number")


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, apart: bool = False, special_as_text: bool = True, ids: bool = False) -> DataFrame:
    """The pieces (see `pieces`) with sequence_id, from 0 on without gaps, and offset, their place in the sequence."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, tokenizer, end, capacity, apart, special_as_text, ids), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row a length
    places = docs.sparkSession.sparkContext.broadcast(Places(packed(counts, capacity)))
    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered(cut, counts).mapInArrow(partial(_placed, places=places), schema)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces packed with ids."""
    held = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return held.select("sequence_id", "length", F.flatten("x.ids").alias("ids"))
