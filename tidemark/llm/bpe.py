"""Byte-level BPE by corpus-level merge replay.

A task gathers the distinct words of a stretch of documents, lays their bytes in one array of symbols, and keeps an
inverted index from each mergeable token pair to the positions where it stands.  Merges are applied in rank order, to
all words at once: words don't touch each other, so a round applies the first merge of every word, in numpy.  A merge
touches only the index entries of its two neighbours.  Long words, which would take many rounds, go through the same in rank
order over all of them.  Words that a worker has seen stay in a bounded table, so each is replayed about once per worker
(in `encode`, per task but for common ones).  There is no shuffle.

Memory is bounded in bytes, whatever the texts: the table of seen words holds REMEMBERED bytes of words and ids, the
table of pairs what the vocabulary gives, a stretch CHARS_AT_ONCE characters, and finished rows go out when they fill SENT_AT_ONCE
bytes; the texts themselves go out only if they are asked for.

Nulls count as empty text.  An empty text has no ids; its digests are those of no bytes.  A text of any length works:
long ones go through in slices of words.  Repeated rows are each encoded.  An empty table gives an empty result.
A column that is named like an output is replaced by it; any other passes through.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import trim

#: Bytes of words and ids that a worker remembers (as objects, these take about twelve times that), bytes of a longest remembered
#: word, words or characters that are in memory at once, and bytes of finished rows.
REMEMBERED, LONGEST, AT_ONCE, CHARS_AT_ONCE, SENT_AT_ONCE = 8_000_000, 64, 120_000, 1_200_000, 4_000_000

#: Bytes of a longest word whose merges are applied in rounds.
SHORT = 64

DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Pairs:
    """Ranks of many token pairs at once, from a table with open addressing."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ranks: np.ndarray):
        bits = max(4, (4 * len(ranks)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = self._keys(a, b)
        slots, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]  # of several for a slot the last stays, the others go on
            put = self.keys[at] == keys[todo]
            self.ranks[at[put]] = ranks[todo[put]]
            todo = todo[~put]
            slots[todo] = (slots[todo] + 1) & self.mask

    def _keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) << 32 | b

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = self._keys(a, b)
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.ranks[slots], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slots[todo] = at = (slots[todo] + 1) & self.mask
            there = self.keys[at]
            same = there == keys[todo]
            out[todo[same]] = self.ranks[at[same]]
            todo = todo[~same & (there >= 0)]
        return out


class MergeReplay:
    """Applies merges to many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.first = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
        # of each token, the tokens that it merges with and what they make: one entry for each way to cut a token in two
        none: dict[int, int] = {}
        self.follow: list[dict[int, int]] = [none] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    if self.follow[a] is none:
                        self.follow[a] = {}
                    self.follow[a][b] = rank
        cuts = [(a, b, rank) for a, found in enumerate(self.follow) for b, rank in found.items()]
        self.pairs = Pairs(*np.array(cuts, np.int32).reshape(-1, 3).T)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, four bytes each."""
        whole = [self.ranks.get(word) for word in words]
        cut = [word for word, rank in zip(words, whole, strict=True) if rank is None and word]
        made = [iter(self._cut([word for word in cut if (len(word) > SHORT) == long], replay)) for long, replay in enumerate((self._rounds, self._replay))]
        return [next(made[len(word) > SHORT]) if rank is None and word else b"" if rank is None else rank.to_bytes(4, sys.byteorder) for word, rank in zip(words, whole, strict=True)]

    def _cut(self, words: list[bytes], replay) -> list[bytes]:
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        after, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        after[ends - 1] = before[ends - lengths] = -1
        ranks = np.full(len(raw), -1, np.int32)
        ranks[:-1] = self.first[raw[:-1], raw[1:]]
        ranks[ends - 1] = -1
        left = replay(self.single[raw], before, after, ranks, np.repeat(np.arange(len(words)), lengths))
        alive = left >= 0
        ids, upto = left[alive].tobytes(), np.cumsum(alive)[ends - 1] * 4
        return [ids[i:j] for i, j in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def _rounds(self, symbols: np.ndarray, before: np.ndarray, after: np.ndarray, ranks: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The index is one array, by rank and then place.  Words don't touch each other, so each round takes the first entry of
        every word at once.  What is left of a merge stands at the place of its first symbol; the other becomes -1.

        ranks: of the pair that begins at a place, or -1; an entry that no longer agrees with it is dropped."""
        places = np.flatnonzero(ranks >= 0)
        index = np.sort(ranks[places].astype(np.int64) << 32 | places)
        first = np.zeros(len(word), np.int64)
        while len(index):
            places = index & 0xFFFFFFFF
            mine, nth = word[places], np.arange(len(index))
            first[mine[::-1]] = nth[::-1]
            chosen = first[mine] == nth
            p, made = places[chosen], (index[chosen] >> 32).astype(np.int32)
            q = after[p]
            left, right = before[p], after[q]
            symbols[p], symbols[q], ranks[q], after[p] = made, -1, -1, right
            inner = right >= 0
            before[right[inner]] = p[inner]
            ranks[p] = -1
            ranks[p[inner]] = self.pairs(made[inner], symbols[right[inner]])
            inner = left >= 0
            left = left[inner]
            ranks[left] = self.pairs(symbols[left], made[inner])
            old, touched = ~chosen & (ranks[places] == index >> 32), np.r_[p, left]
            touched = touched[ranks[touched] >= 0]
            index = np.sort(np.r_[index[old], ranks[touched].astype(np.int64) << 32 | touched])
        return symbols

    def _replay(self, symbols: np.ndarray, before: np.ndarray, after: np.ndarray, ranks: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Merges in rank order, as a long word would take a round for each of its merges."""
        # the index of the first pairs, all places of a pair in order
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        kinds, begin = np.unique(ranks[places], return_index=True)
        where = {rank: x.tolist() for rank, x in zip(kinds.tolist(), np.split(places, begin[1:]), strict=True)} if len(places) else {}
        symbols = symbols.tolist()
        self._replay_lists(symbols, before.tolist(), after.tolist(), where)
        return np.array(symbols, np.int32)

    def _replay_lists(self, symbols: list[int], before: list[int], after: list[int], where: dict[int, list[int]]) -> None:
        follow = self.follow
        queue = sorted(where)
        while queue:
            rank = heappop(queue)
            places = where.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, p in enumerate(places):
                q = after[p]
                if symbols[p] < 0 or q < 0 or follow[symbols[p]].get(symbols[q], -1) != rank:
                    continue
                symbols[p], symbols[q] = rank, -1
                left, right = before[p], after[q]
                after[p] = right
                lowest = rank
                if right >= 0:
                    before[right] = p
                    if (found := follow[rank].get(symbols[right], -1)) >= 0:
                        if found not in where:
                            where[found] = []
                            heappush(queue, found)
                        where[found].append(p)
                        lowest = min(lowest, found)
                if left >= 0 and (found := follow[symbols[left]].get(rank, -1)) >= 0:
                    if found not in where:
                        where[found] = []
                        heappush(queue, found)
                    where[found].append(left)
                    lowest = min(lowest, found)
                if lowest < rank:  # a merge that now comes first; what is left here waits
                    where.setdefault(rank, []).extend(places[k + 1 :])
                    heappush(queue, rank)
                    break


#: What `latin` can turn into characters: the classes, and what stands for itself in both libraries.
_CLASS, _PLAIN = re.compile(r"\\p\{L\}|\\p\{N\}|\\s"), re.compile(r"(?:\[\^?(?:\\p\{L\}|\\p\{N\}|\\s|[A-Za-z0-9 '])+\]|\\p\{L\}|\\p\{N\}|\\s|\\S|\(\?[!=:]|[A-Za-z0-9 '|)+*?])*")


def latin(pattern: str) -> re.Pattern | None:
    """The pattern for texts of Latin-1 only, with its classes spelt out, for the faster library; None if it has more than these."""
    if not _PLAIN.fullmatch(pattern):
        return None
    all_latin = "".join(map(chr, range(256)))
    spelt = {kind: "".join(f"\\x{ord(c):02x}" for c in regex.findall(kind, all_latin)) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    in_sets = re.sub(r"\[[^\]]*\]", lambda m: _CLASS.sub(lambda x: spelt[x[0]], m[0]), pattern)
    return re.compile(_CLASS.sub(lambda x: f"[{spelt[x[0]]}]", in_sets).replace(r"\S", rf"[^{spelt[r'\s']}]"))


def is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _joined(values: pa.Array) -> memoryview:
    """The bytes of all values, which follow each other in memory."""
    _, offsets, data = values.buffers()
    return memoryview(data)[: int(np.frombuffer(offsets, np.int64)[len(values)])]


class Encoder:
    """Ids are kept as four bytes each, so that those of a text are its words' joined."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.find, self.latin = MergeReplay(ranks), regex.compile(pattern), latin(pattern)
        self.known: dict[str, bytes] = {}
        self.last: set[str] = set()
        self.held = 0
        tokens = self.replay.tokens
        self.shown = pa.array([f",{rank}" if rank in tokens else "" for rank in range(max(tokens) + 1)], pa.large_string())
        self.tokens = pa.array([tokens.get(rank, b"") for rank in range(max(tokens) + 1)], pa.large_binary())

    def shrink(self) -> None:
        """Remembers only words of the last stretch, the common ones among them."""
        self.known = {x: self.known[x] for x in self.last if x in self.known}
        self.held = sum(len(x.encode()) + len(ids) for x, ids in self.known.items())
        self.last = set()

    def words(self, text: str) -> Iterator[list[str]]:
        if len(text) <= CHARS_AT_ONCE:
            yield (self.latin if self.latin and is_latin(text) else self.find).findall(text)
            return
        found = (m.group() for m in self.find.finditer(text))
        while part := list(islice(found, AT_ONCE)):
            yield part

    def ids(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of words."""
        if self.held > REMEMBERED:
            self.shrink()
        known = self.known
        self.last = set().union(*lists)
        new = list(self.last.difference(known))
        words = [x.encode() for x in new]
        long = []
        for x, word, made in zip(new, words, self.replay(words), strict=True):
            known[x] = made
            if len(word) > LONGEST:
                long.append(x)
            else:
                self.held += len(word) + len(made)
        out = [b"".join(map(known.__getitem__, x)) for x in lists]
        for x in long:
            del known[x]
        return out

    def documents(self, texts: Iterable[str | None]) -> Iterator[Iterator[bytes]]:
        """For each text, its ids in one piece or, if it is very long, in several."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > CHARS_AT_ONCE:
                yield from ([ids] for ids in self.ids(held))
                held, size = [], 0
                yield (self.ids([part])[0] for part in self.words(text))
                continue
            held.append(next(self.words(text)))
            size += len(text)
            if size > CHARS_AT_ONCE:
                yield from ([ids] for ids in self.ids(held))
                held, size = [], 0
        yield from ([ids] for ids in self.ids(held))

    def digest(self, parts: Iterable[bytes]) -> tuple[int, str, str]:
        n, shown, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for part in parts:
            ids = pa.array(np.frombuffer(part, np.int32))
            if len(ids):
                shown.update(_joined(self.shown.take(ids))[n == 0 :])
                decoded.update(_joined(self.tokens.take(ids)))
                n += len(ids)
        return n, shown.hexdigest(), decoded.hexdigest()


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(held, pattern: str) -> Encoder:
    """One for a worker, which outlives its tasks."""
    key = (held.id if hasattr(held, "id") else id(held), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(held.value, pattern)
    return _encoders[key]


def _with(docs: DataFrame, text: str, more: list[T.StructField], rows, drop: bool = False, keep: bool = True) -> DataFrame:
    """docs with columns that `rows` makes of a batch's texts, in pieces; without the text itself if it is to be dropped.
    keep: whether a worker keeps its table of words for its next task, rather than only the common ones."""
    names = [f.name for f in more]
    kept = [c for c in docs.columns if c not in names and not (drop and c == text)]
    fed = docs.select(*kept) if text in kept else docs.select(*kept, docs[text].alias("__text"))
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept] + more)

    def run(batches):
        for batch in batches:
            at = 0
            for made in rows(batch.column(batch.schema.get_field_index(text if text in kept else "__text"))):
                n = len(made[0])
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).slice(at, n) for c in kept] + made, names=kept + names)
                at += n
        if not keep:
            for encoder in _encoders.values():
                encoder.shrink()
            trim()

    return fed.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", digests: bool = False, drop: bool = False) -> DataFrame:
    """docs with `ids`, and with the digests of `digest` if asked for; without the text if it is to be dropped.  As other
    operators often run in the same workers, these keep only common words between tasks."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def rows(column):
        encoder = _encoder(held, pattern)
        lengths, values, size, said = [0], [], 0, []

        def made():
            ids = pa.Array.from_buffers(pa.int32(), sum(lengths), [None, pa.py_buffer(b"".join(values))])
            return [pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), ids)] + (_columns(said) if digests else [])

        for parts in encoder.documents(x.as_py() for x in column):
            ids = b"".join(parts)
            values.append(ids)
            lengths.append(len(ids) // 4)
            size += len(ids)
            if digests:
                said.append(encoder.digest([ids]))
            if size > SENT_AT_ONCE:
                yield made()
                lengths, values, size, said = [0], [], 0, []
        yield made()

    return _with(docs, text, IDS.fields + (DIGEST.fields if digests else []), rows, drop, keep=False)


def _columns(rows: list[tuple[int, str, str]]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]


def digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """docs with the number of ids, the hash of the ids, and the hash of the bytes that the ids decode to."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def rows(column):
        encoder = _encoder(held, pattern)
        yield _columns([encoder.digest(parts) for parts in encoder.documents(x.as_py() for x in column)])

    return _with(docs, text, DIGEST.fields, rows)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """encoded with `decoded`: the bytes that the ids stand for; null ids decode to no bytes."""
    held = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    def rows(column):
        tokens = held.value
        yield [pa.array([b"".join(map(tokens.__getitem__, x.as_py() or [])) for x in column], pa.binary())]

    return _with(encoded, ids, [T.StructField("decoded", T.BinaryType())], rows)
