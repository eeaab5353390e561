"""Queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lsmframe.plans.queries import ORACLE, QUERIES

SMALLEST = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    if not SMALLEST.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in SMALLEST.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def ordered(rows) -> list:
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("store_")])
def test_query_equals_its_sql(spark, tables, name):
    got = QUERIES[name](spark, str(SMALLEST))
    want = tables.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert ordered(got.select(*names).collect()) == ordered(want.fetchall())
