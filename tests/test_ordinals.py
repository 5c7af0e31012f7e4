"""Places of rows against a plain sort; pages read their partitions only."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordinals


def test_places_are_those_of_a_sort(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, "hot", "hot", f"k{rng.randrange(50)}"]), k, "x" * (k % 3)) for k in range(3000)]
    rows = spark.createDataFrame(data, "key string, _part int, `odd.name` string").repartition(7)
    done = ordinals.numbered(rows, [F.desc_nulls_last("key"), "_part"], parts=9)
    want = sorted(data, key=lambda r: r[1])
    want.sort(key=lambda r: r[0] or "", reverse=True)
    got = [tuple(r) for r in done.rows().orderBy("ordinal").collect()]
    assert got == [(*r, k + 1) for k, r in enumerate(want)]
    assert done.total() == 3000 and done.offsets().count() > 4
    plan = done.rows()._jdf.queryExecution().toString()
    assert "Window" not in plan
    for page in (1, 7, 30, 31, -2):
        start = (max(1, page) - 1) * 100
        assert [tuple(r) for r in done.page(page, 100).collect()] == [(*r, start + k + 1) for k, r in enumerate(want[start : start + 100])]
    assert len(done.page(3, 100).select(F.input_file_name()).distinct().collect()) <= 2


def test_copies_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a")] * 500 + [(1, "b")] * 5 + [(0, None)], "n int, t string")
    done = ordinals.numbered(rows, ["n"], parts=4)
    placed = done.rows("place").collect()
    assert sorted(r["place"] for r in placed) == list(range(1, 507)) and min(placed, key=lambda r: r["place"])["t"] is None
    none = ordinals.numbered(rows.where("n > 5"), ["n"])
    assert (none.rows().count(), none.page(1).count(), none.total()) == (0, 0, 0)
    with pytest.raises(ValueError, match="no column"):
        ordinals.numbered(rows.select(), [F.lit(1)])
