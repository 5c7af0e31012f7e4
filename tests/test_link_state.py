"""Summaries of batches against one summary of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import link_state, links

SCHEMA = link_state._LINKS


def made(rng, n):
    """Links of few keys, so that most come more than once; a key's domain is that of its page."""
    out = []
    for _ in range(n):
        page, target = rng.randrange(40), rng.randrange(3)
        is_live, nofollow = rng.choice([True, False, None]), rng.random() < 0.3
        url = None if page == 39 else f"https://d{page % 9}.com/{page}"
        out.append((url, f"d{page % 9}.com", f"https://t.com/{target}", rng.choice(["a", None]), "nofollow" if nofollow else "", not nofollow, is_live, False, rng.choice([200, 404, None])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_whole(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = made(rng, 400)
    whole = links.summary(links.dedupe(spark.createDataFrame(data, SCHEMA))).first()
    state = link_state.LinkState(spark, str(tmp_path / "state"))
    cuts = sorted(rng.sample(range(1, 400), 3))
    parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, 400], strict=True)]
    for k, part in enumerate([*parts, []]):
        state.merge(spark.createDataFrame(part, SCHEMA), k)
    assert state.summary().first() == whole
    state.merge(spark.createDataFrame([], SCHEMA), 4)
    state.merge(spark.createDataFrame(parts[3], SCHEMA), 3)
    assert state.summary().first() == whole
    # what stands is as good as what one pass keeps
    order = ["source_url", "target_url", "anchor", "live", "http_status", "rel"]
    assert sorted(map(repr, state.links().select(*order).collect())) == sorted(map(repr, links.dedupe(spark.createDataFrame(data, SCHEMA)).select(*order).collect()))
    assert state.domains_estimate().first()["domains"] >= whole["domains"]


def test_empty_state_and_missing_columns(spark, tmp_path):
    state = link_state.LinkState(spark, str(tmp_path / "none"))
    empty = state.summary().first()
    assert (empty["candidates"], empty["live"], empty["concentration"], state.domains_estimate().first()["domains"]) == (0, 0, 0.0, 0)
    rows = spark.createDataFrame([("https://a.com/", "a.com", "https://t.com/", "x", True, 7)], "source_url string, source_domain string, target_url string, anchor string, live boolean, batch int")
    state.merge(rows, 0)
    got = state.summary().first()
    assert (got["candidates"], got["live"], got["domains"], got["follow"]) == (1, 1, 1, 0)


def test_stream(spark, tmp_path):
    data = made(random.Random(3), 90)
    for k in range(3):
        spark.createDataFrame(data[30 * k : 30 * k + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = link_state.LinkState(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(state.each_batch()).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and state.domains().agg(F.sum("n")).first()[0] == state.links().count()
    assert state.summary().first() == links.summary(links.dedupe(spark.createDataFrame(data, SCHEMA))).first()
