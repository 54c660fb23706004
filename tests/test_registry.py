"""Every registered query with SQL equals DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import math

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {path.split('/')[-1][:-8]} as select * from '{path}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(v)
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return f"{v} 00:00:00"
    return str(v) if isinstance(v, datetime.datetime) else v


def rough(row):
    return repr([float("%.5g" % v) if isinstance(v, float) else v for v in row])


def same(a, b):
    return len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, (int, float)) else x == y for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in found.collect()]
    assert len(set(found.columns)) == len(found.columns)
    if name not in registry.ORACLE_SQL:
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    order = lambda cols: sorted(range(len(cols)), key=lambda k: cols[k])
    a = sorted((tuple(plain(r[k]) for k in order(found.columns)) for r in rows), key=rough)
    b = sorted((tuple(plain(r[k]) for k in order(want.columns)) for r in want.fetchall()), key=rough)
    assert len(a) == len(b)
    assert all(same(x, y) for x, y in zip(a, b)), next((x, y) for x, y in zip(a, b) if not same(x, y))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["date", "top", "low", "weighted", "inverse", "all_names", "n", "excess"]


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
