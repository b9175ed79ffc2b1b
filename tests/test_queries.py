"""Every query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from cellmosaic.plans.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DIR):
        pytest.skip("no test data here")
    found = duckdb.connect()
    for t in TABLES.split():
        found.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert rows
        return
    want = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = lambda columns, rs: sorted((repr([r[columns.index(c)] for c in sorted(columns)]) for r in rs))
    assert order(df.columns, rows) == order(want.columns, want.fetchall())
