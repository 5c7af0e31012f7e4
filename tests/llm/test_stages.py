"""The pipeline against brute force, its stages and the operators on odd rows."""

import random

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import ann, language_id, licenses, quality, queries, toxicity, url_filter
from tidemark.llm.common import Scratch, table

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sql(docs, query):
    """The rows of a query's SQL with the given documents, as dictionaries."""
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SMALL}/benchmark.parquet')")
    said = c.execute(queries.SQL[query])
    names = [d[0] for d in said.description]
    return {r["doc_id"]: r for r in (dict(zip(names, row, strict=True)) for row in said.fetchall())}


def test_pipeline_agrees_with_brute_force(spark):
    """Each stage is held against SQL over its own input; the classifier's decisions are those of its scores."""
    scratch = Scratch(spark, "test-stages")
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name == "quality":
            scored = quality.quality(docs.select("doc_id", "text"), table(spark, SMALL, "labels").select("doc_id", "quality"))
            want = {r["doc_id"]: before[r["doc_id"]] for r in scored.where("predicted = 1").collect()}
        elif name == "line_dedup":
            said = sql(docs, "op2_line_dedup")
            want = {d: r if not said[d]["n_removed"] else r | {"text": said[d]["text"], "n_chars": len(said[d]["text"])} for d, r in before.items() if not said[d]["n_removed"] or said[d]["text"]}
        elif name == "ngram_join":
            said = sql(docs, "op7_ngram_join")
            want = {d: r for d, r in before.items() if said[d]["group_id"] == d}
        elif name == "decontaminate":
            said = sql(docs, "op3_decontaminate")
            want = {d: r for d, r in before.items() if not said[d]["contaminated"]}
        else:
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queries.ranks(), special_tokens={})
            want = {d: library.encode_ordinary(r["text"] or "") for d, r in before.items()}
        docs = scratch.keep(stage(spark, docs, SMALL), name)
        rows = docs.collect()
        assert len(rows) == len({r["doc_id"] for r in rows})
        if name == "byte_bpe":
            assert {r["doc_id"]: list(r["ids"]) for r in rows} == want
        else:
            assert docs.columns == columns
            assert 0 < len(want) <= len(before)
            assert {r["doc_id"]: r.asDict() for r in rows} == want
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in whole} == want and len(whole) == len(want)


CLASHING = ["n_removed", "keep", "contaminated", "score", "label", "ids", "rid", "_d", "_t"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, an exact copy, a benchmark passage, columns named like the stages' own."""
    a = "one two three four five six seven eight nine ten eleven"
    item = table(spark, SMALL, "benchmark").where("text is not null").orderBy(F.desc(F.length("text")), "item_id").first()["text"]
    long = " ".join(f"own{k}" for k in range(40_000))
    texts = [(1, None), (2, ""), (3, long), (4, a), (4, a), (5, a), (None, "quite other words stand here for once and all now"), (6, "short"), (7, item)]
    rows = [(d, t, None, None, None if t is None else len(t)) for d, t in texts]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in CLASHING})


@pytest.mark.parametrize("name, ids", [("quality", None), ("line_dedup", [1, 2, 3, 4, 4, 6, 7, None]), ("ngram_join", [1, 2, 3, 4, 6, 7, None]), ("decontaminate", [1, 2, 3, 4, 4, 5, 6, None]), ("byte_bpe", [1, 2, 3, 4, 4, 5, 6, 7, None])])
def test_stages_on_odd_rows(spark, odd, name, ids):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, SMALL)
    got = out.collect()
    if ids is not None:
        assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(map(repr, ids))
    if name != "byte_bpe":
        assert out.columns == odd.columns
        given = [repr(r) for r in odd.collect()]
        assert all(repr(r) in given for r in got)
    else:
        assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1: 0, 2: 0}
    assert stage(spark, odd.limit(0), SMALL).count() == 0


def test_scores_of_empty_tables_repeated_rows_and_clashing_columns(spark, odd):
    labels = table(spark, SMALL, "labels")
    texts = odd.withColumns({"predicted": F.lit("mine"), "lang_pred": F.lit("mine"), "held_out": F.lit("mine")})
    runs = {
        "toxic": lambda d: toxicity.toxicity(d, labels.select("doc_id", "toxic")),
        "quality": lambda d: quality.quality(d, labels.select("doc_id", "quality")),
        "language": lambda d: language_id.language_id(d.withColumn("lang", F.lit("xx"))),
    }
    for name, run in runs.items():
        rows = run(texts).collect()
        assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows), name
        assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1, name
        assert run(texts.limit(0)).count() == 0, name


def test_licenses_of_empty_tables_and_repeated_rows(spark):
    mit = "Released under the MIT License."
    rows = [(1, mit), (1, mit), (None, mit), (2, ""), (3, f"{'word ' * 50_000}{mit}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("license", "containment", "n", "k")})
    got = licenses.scan(docs).collect()
    assert sorted((repr(r["doc_id"]), r["license"]) for r in got) == [("1", "MIT"), ("3", "MIT"), ("None", "MIT")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_nearest_with_other_lengths_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("mine") for c in ("rank", "score", "query_id", "shard")})
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 1), (0, 2, 2)]


def brute_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))[1:]


def test_url_rules_agree_with_brute_force(spark):
    rng = random.Random(5)
    labels, parts = ["a", "b", "com", "net", "x-y"], ["/", "/en/", "/en", "/es/1", ""]
    rules = sorted({(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randrange(1, 4))), rng.choice(parts[:4])) for _ in range(60)})
    whole = [(".".join(rng.choices(labels, k=rng.randrange(1, 5))), rng.choice(parts) + rng.choice(["", "z" * 3])) for _ in range(300)]
    whole = [(h, p if p.startswith("/") else "") for h, p in whole] + [("a.com", "/en/" + "z" * 100_000)]
    urls = spark.createDataFrame([(k, f"http://{h.upper()}{p}?q=/en/#t") for k, (h, p) in enumerate(whole)] * 2, "page_id long, url string")
    for more in ([], [("block", f"z{k}.test", "/") for k in range(200)]):
        got = url_filter.filter_urls(urls, rules + more).collect()
        assert len(got) == 2 * len(whole)
        for r in got:
            rule, verdict = brute_rule(*whole[r["page_id"]], rules)
            assert (r["host"], r["path"], r["rule"]) == (*whole[r["page_id"]], rule)
            assert r["verdict"] == (verdict or ("block" if r["block_score"] >= 0.5 else "allow"))
    empty = url_filter.filter_urls(urls.limit(0), rules)
    assert empty.count() == 0
