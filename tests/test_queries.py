"""Every query with an SQL twin gives the twin's rows on the smallest test data."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TABWEAVE_TEST_DIR", "/root/testdata/sf0.001")
LLM = {n for n in entry.queries() if n.startswith("p") and n.split("_")[0][1:].isdigit() and n.split("_")[0] not in ("p1", "p3")}


def shown(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "~"
    if isinstance(v, (list, np.ndarray)):
        return str([shown(x) for x in v])
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating, int, np.integer)):
        return f"{float(v):.8g}"
    return str(v)


def rows(df):
    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - LLM))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
