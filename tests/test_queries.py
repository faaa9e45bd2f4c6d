"""Every query with SQL gives the same rows in DuckDB."""

import glob
import importlib
import math
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from quern.plans import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v if math.isinf(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def answers(request, spark, small):
    """The rows of the queries that were asked for, a few at a time: planning small queries is most of the work."""
    asked = [i.callspec.params["name"] for i in request.session.items if i.fspath == request.fspath and hasattr(i, "callspec")]

    def run(name):
        df = QUERIES[name](spark, small)
        return df.columns, df.collect()

    with ThreadPoolExecutor(4) as pool:
        yield {n: pool.submit(run, n) for n in asked}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(answers, duck, name):
    columns, rows = answers[name].result()
    rel = duck.sql(ORACLE[name])
    assert sorted(columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(map(plain, r)) for r in rows), key=repr)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(answers, name):
    columns, rows = answers[name].result()
    assert columns and rows


def test_entry(spark, small):
    e = importlib.import_module("__spark_entry__")
    assert set(ORACLE) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert len(e.entry(spark).columns) > 10
