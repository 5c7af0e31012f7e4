"""Ranked search, packing and fill-in-middle against brute force, libraries and SQL."""

import hashlib
import itertools
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import fim, lexical, packing, queries
from tidemark.llm.common import table

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = ["", None, "a", "\x01 a\x01b \x01", "no newline at the end", "\n", "\n\n\n", "a\nb\r\n\n c", "x <P> y", "<M>", "<S", "P>\n<", "é—😀\nÀÉ\n日本語\n", "a\x1cb\x1d c  　d", "<|endoftext|> is text", "x" * 30_000, ("line " * 30 + "\n") * 400]


# --- search ------------------------------------------------------------------------------------------------------------------


def terms(text):
    return [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in TERM.findall(text or "")]


def ranked(docs, items, k):
    held = [(d, terms(x)) for d, x in docs]
    held = [(d, w) for d, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = Counter(x for _, w in held for x in set(w))
    out = []
    for item, text in items:
        found = []
        for d, w in held:
            c = Counter(w)
            m = 100 - 50 + (50 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 20 * m)) for x in set(terms(text)) if x in c)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda y: (y[0], y[1], y[2] or 0))[:k], 1)]
    return out


def some_texts(n, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdé日", k=rng.randint(1, 3))) for _ in range(60)]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 10, 60]))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_agrees_with_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "TERMS", 25)  # several blocks
    docs = list(enumerate([*some_texts(300), *["same words here"] * 70, "", None, "... !", "A-b,C", "word " * 5000])) + [(None, "same words here")]
    items = [*enumerate(some_texts(9, 6)), (100, "same"), (100, "SAME words here unknown"), (101, None), (102, "?!"), (103, "unknown")]
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, "item_id long, text string"), k)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, ranked(docs, items, k)))


def test_bounds_hold_for_every_score(spark):
    tf, n = np.arange(1, 400), np.tile([1, 7, 90, 100_000], 100)[:399]
    r = lexical.impacts(tf, n, 1000, 90_000)
    held = -(-r // lexical.UNIT)
    assert held.max() <= 255 and (held * lexical.UNIT >= r).all() and ((held - 1) * lexical.UNIT < np.maximum(r, 1)).all()


def test_search_of_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "x", 5)], DOCS + ", query string, q int")
    items = spark.createDataFrame([(7, "two", "y")], "item_id long, text string, rank string")
    assert [tuple(r) for r in lexical.search(docs, items).collect()][0][:3] == (7, 1, 1)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


# --- packing -----------------------------------------------------------------------------------------------------------------


def fewest(lengths, capacity):
    """The least number of sequences, by trying all ways."""
    best = [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0] and k < len(lengths) or len(rooms) > best[0]:
            return
        if k == len(lengths):
            best[0] = min(best[0], len(rooms))
            return
        for r in sorted({x for x in rooms if x >= lengths[k]}):
            rest = list(rooms)
            rest.remove(r)
            go(k + 1, [*rest, r - lengths[k]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


def test_plan_is_close_to_the_fewest():
    rng = random.Random(3)
    for _ in range(25):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        counts = Counter(lengths)
        made = packing.packed(dict(counts), 30)
        assert sum((Counter({x: k * n for x, k in Counter(some).items()}) for n, some in made), Counter()) == counts
        assert all(n > 0 and sum(some) <= 30 for n, some in made)
        best = fewest(lengths, 30)
        assert packing.least(dict(counts), 30) <= best <= sum(n for n, _ in made) <= best + 1


def test_plan_of_many_pieces_reaches_the_lower_bound():
    rng = random.Random(4)
    counts = Counter(min(4096, int(rng.lognormvariate(6.3, 1.1)) + 1) for _ in range(20_000))
    made = sum(n for n, _ in packing.packed(dict(counts)))
    assert packing.least(dict(counts)) <= made <= 1.002 * packing.least(dict(counts))
    only = packing.packed({1500: 10**9, 1100: 2 * 10**9})  # counts of any size, in the same time
    assert sum(n for n, _ in only) <= 1.01 * 10**9


def test_linear_program_covers_and_bounds():
    groups = [(60, 40), (50, 30), (33, 90), (20, 50)]
    found, bound = packing.configurations(groups, 100)
    took = [sum(c[g] * x for c, x in found.items()) for g in range(4)]
    assert all(sum(k * groups[g][0] for g, k in enumerate(c)) <= 100 for c in found)
    assert all(t <= n + 1e-6 for t, (_, n) in zip(took, groups, strict=True))
    assert bound <= sum(found.values()) / min(t / n for t, (_, n) in zip(took, groups, strict=True)) <= 1.1 * bound


def test_knapsack_agrees_with_all_ways():
    rng = np.random.default_rng(1)
    for _ in range(30):
        size, copies, worth = rng.integers(1, 9, 4), rng.integers(0, 4, 4), rng.random(4)
        got = packing.knapsack(worth, size, copies, 17)
        best = max(sum(k * w for k, w in zip(ks, worth, strict=True)) for ks in itertools.product(*(range(c + 1) for c in copies)) if np.dot(ks, size) <= 17)
        assert np.dot(got, size) <= 17 and (got <= copies).all() and abs(np.dot(got, worth) - best) < 1e-9


def check_packed(rows, texts, capacity, end):
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORDS))
    library.encode_special_tokens = True
    wanted = Counter()
    for d, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            x = ids[start : start + capacity]
            wanted[d, piece, start, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1] and sum(n for _, n in spans) <= capacity
    return len(held)


def test_packing_query_agrees_with_the_library(spark):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    rows = queries.op12_packing(spark, SMALL).collect()
    lengths = Counter(r["length"] for r in rows)
    assert check_packed(rows, texts, 4096, 1) <= packing.least(dict(lengths)) + 1


@pytest.mark.parametrize("apart", [True, False])
def test_packing_of_odd_rows(spark, monkeypatch, apart):
    monkeypatch.setattr(packing, "TOGETHER", 3)
    monkeypatch.setattr(packing, "AT_ONCE", 500)
    texts = [*enumerate(ODD), *[(5, "twice")] * 2, (None, "a b"), *[(k, "same length") for k in range(40)]]
    docs = spark.createDataFrame([(*x, "mine", 1) for x in texts], DOCS + ", piece string, salt int").repartition(3)
    made = packing.pack(docs, public_tokenizers.path(queries.WORDS), end=1, capacity=64, apart=apart, ids=True)
    rows = made.collect()
    check_packed(rows, texts, 64, 1)
    by_sequence = {r["sequence_id"]: r["ids"] for r in packing.sequences(made).collect()}
    assert all(by_sequence[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in rows)
    assert packing.pack(docs.limit(0), public_tokenizers.path(queries.WORDS), end=1).count() == 0


def test_packing_asks_the_model_once_for_a_word(monkeypatch):
    with open(public_tokenizers.path(queries.WORDS), encoding="utf-8") as f:
        made = f.read()
    encoder, rng = packing.Encoder(made, apart=True, special_as_text=True), random.Random(3)
    kinds = [*map(chr, range(256)), "'S", "'LL", "don't", "Ünï", "12", "<|endoftext|>", "\x01", "日", "Σ", "İ"] * 2 + [" "] * 60 + ["e"] * 60
    texts = ["".join(rng.choices(kinds, k=rng.randrange(80))) for _ in range(2_000)]
    assert encoder(texts, odd=True) == encoder._encoded(texts)
    asked, modelled = [], encoder._modelled
    monkeypatch.setattr(encoder, "_modelled", lambda words: asked.extend(words) or modelled(words))
    monkeypatch.setattr(encoder, "_told", lambda some: pytest.fail("the whole library") if some else [])
    texts = ["Zyxwvut zyxwvut, (ZYXWVUT) zyxwvut.", "été zyxwvut! 77"]
    assert encoder(texts, odd=False) == encoder._encoded(texts) and asked.count("zyxwvut") == 1
    encoder.last[:] = True  # as if tokens within words were named like last ones
    assert modelled(["zyxwvut", "été"]) == encoder._encoded(["zyxwvut", "été"])


def test_packing_with_other_steps_asks_the_whole_library():
    with open(public_tokenizers.path(queries.WORDS), encoding="utf-8") as f:
        made = json.loads(f.read())
    assert packing._words(made) is not None
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"model": made["model"] | {"end_of_word_suffix": None}}, {"added_tokens": [made["added_tokens"][0] | {"special": False}]}):
        assert packing._words(made | change) is None
    assert packing.Encoder(json.dumps(made), apart=True, special_as_text=False).find is None


# --- fill-in-middle ----------------------------------------------------------------------------------------------------------


UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"[\s\S]", "word": r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+"}


def filled(doc_id, text, unit="line", rate=100, spm=50, seed="7"):
    text = text or ""
    units = regex.findall(UNITS[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("char", 70, 0), ("word", 90, 100)])
def test_fim_agrees_with_brute_force(spark, monkeypatch, unit, rate, spm):
    monkeypatch.setattr(fim, "AT_ONCE", 2_000)
    texts = [*enumerate(ODD * 3), (None, "a\nb\nc"), (4, "again"), (4, "again")]
    docs = spark.createDataFrame([(*x, "mine") for x in texts], DOCS + ", Form string").repartition(2)
    made = fim.fill_in_middle(docs, unit=unit, rate=rate, spm=spm)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.withColumn("again", fim.restored()).collect()
    assert sorted(repr((r["doc_id"], r["text"], *r[2:7])) for r in rows) == sorted(repr((d, x, *filled(d, x, unit, rate, spm))) for d, x in texts)
    assert all(r["again"] == (r["text"] or "") for r in rows)


def test_fim_of_the_whole_table_and_of_none(spark):
    docs = table(spark, SMALL, "documents")
    rows = fim.fill_in_middle(docs).collect()
    assert all(tuple(r)[len(docs.columns) :] == filled(r["doc_id"], r["text"]) for r in rows) and {r["form"] for r in rows} == {"psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert fim.fill_in_middle(docs.select("doc_id", "text"), keep_text=False).columns[0] == "doc_id"


def test_fim_with_other_sentinels(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "(x)|\ny")], DOCS)
    marks = ("(p)|", "(s)|", "(m)|")
    rows = fim.fill_in_middle(docs, sentinels=marks).withColumn("again", fim.restored(sentinels=marks)).collect()
    assert all(r["again"] == r["text"] and r["form"] != "plain" for r in rows)
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("ab", "bc", "x"), ("<P>x", "<P>", "y")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.fill_in_middle(docs, sentinels=bad)


def test_restored_digest_is_that_of_the_text(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("x"))
    made = queries.op13_fill_in_middle(spark, SMALL)
    assert made.join(docs, "doc_id").where("restored_sha256 = x").count() == docs.count()
