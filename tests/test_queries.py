"""Registered queries against their SQL in DuckDB at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")) or n == "pipeline_warmup")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    cols = sorted(df.columns)
    key = lambda rows: sorted(map(repr, rows))
    have = key(tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    want = key(sql.select(*(f'"{c}"' for c in cols)).fetchall())
    assert have == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
