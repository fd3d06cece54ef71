"""Every query with SQL against DuckDB on the smallest tables; every query runs and has rows."""

import glob
import os

import duckdb
import pytest

from folioflow.plans import registry

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert rows
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert sorted(repr(tuple(r[k] for k in order)) for r in found.fetchall()) == rows
