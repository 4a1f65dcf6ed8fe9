"""Queries against DuckDB over the same tables."""

import os

import duckdb
import pytest

from cellprobe.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_one_aggregate_scans_once(spark):
    from cellprobe.operators.profile import as_cells, counters

    plan = counters(as_cells(spark.read.parquet(f"{DIR}/orders.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
