"""Every registered query against its SQL in DuckDB, on the small test tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.plans.reports import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    said = duck.execute(SQL[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == sorted(got.columns)
    order = [columns.index(c) for c in got.columns]
    want = sorted((repr(tuple(r[k] for k in order)) for r in said.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
