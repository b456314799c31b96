"""Queries of the llm subpackage against their SQL on the smallest test data."""

import glob
import os

import duckdb
import pytest

from tabweave.llm import queries

DIR = os.environ.get("TABWEAVE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    rows = sorted(str(tuple(f"{x:.8g}" if isinstance(x, float) else x for x in r)) for r in got.select(names).collect())
    if name in queries.SQL:
        want = con.execute(f"select {', '.join(names)} from ({queries.SQL[name]})").fetchall()
        assert rows == sorted(str(tuple(f"{x:.8g}" if isinstance(x, float) else x for x in r)) for r in want)
