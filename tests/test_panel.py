import random
from datetime import date, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.functions import alphas, panel
from tidemark.plans import registry

COLUMNS = ["open", "close", "high", "low", "amount", "volume", "vwap"]


def plain_sql(names, rows):
    table = pa.table({n: pa.array(x) for n, x in zip(["symbol", "date", *COLUMNS], zip(*rows))})  # noqa: F841
    c = duckdb.connect()
    c.register("panel", table)
    return {(r[0], r[1]): r[2:] for r in c.execute("WITH daily AS (SELECT * FROM panel), " + alphas.as_sql(names, "daily", ties=True)).fetchall()}


def computed(spark, names, rows):
    df = spark.createDataFrame(rows, "symbol long, date date, " + ", ".join(f"{c} double" for c in COLUMNS))
    return {(r[0], r[1]): tuple(r[2:]) for r in panel.computed(lambda by: df.repartition(by), names, ties=True).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, row in want.items():
        for a, b in zip(got[k], row):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9) or np.isnan(a) and np.isnan(b)), (k, got[k], row)


@pytest.fixture(scope="module")
def rows():
    """Names with long and short histories, days off, unknown values and prices that repeat."""
    rng, out = random.Random(3), []
    for symbol, days in ((1, 420), (2, 400), (3, 380), (4, 300), (5, 60), (6, 7), (7, 1)):
        for k in range(days):
            if rng.random() < 0.05:
                continue
            low, wide = 100 + rng.randint(0, 40) / 4, rng.randint(0, 8) / 4
            price = [low + wide * rng.randint(0, 4) / 4 for _ in range(3)]
            volume = float(rng.randint(1, 30))
            row = [price[0], price[1], low + wide, low, price[2] * volume, volume, price[2]]
            if rng.random() < 0.002:
                row[rng.randrange(7)] = None
            out.append((symbol, date(2000, 1, 1) + timedelta(days=k), *row))
    return out


@pytest.mark.parametrize("k", range(0, 82, 14))
def test_formulas_equal_their_sql_whatever_the_chunks(spark, rows, monkeypatch, k):
    names = list(alphas.FORMULAS)[k : k + 14]
    monkeypatch.setattr(panel, "CHUNK", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        same(computed(spark, names, rows), plain_sql(names, rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_correlations_of_two_rows_round_as_in_sql(spark):
    """Sums near 2 ** 52 have means that are no doubles; how much of that is left after rounding decides the ranks of alpha045."""
    rng, rows = random.Random(9), []
    for symbol in range(40):
        for k in range(40):
            close = float((1 << 48) + rng.randint(0, 1 << 20))
            rows.append((symbol, date(2000, 1, 1) + timedelta(days=k), close, close, close, close, close, float(rng.randint(1, 9)), close))
    same(computed(spark, ["alpha045"], rows), plain_sql(["alpha045"], rows))


def test_values_above_all_others(spark):
    """NaN ranks last of a day and is the largest of a frame."""
    nan, d = float("nan"), date(2000, 1, 1)
    base = [(s, d + timedelta(days=k), 1.0, 2.0 + s, 3.0, 1.0, 4.0, 1.0 + k, nan if s == 2 and k == 3 else 2.0 + s) for s in range(1, 4) for k in range(6)]
    got = computed(spark, ["alpha042", "alpha005"], base)
    assert [got[s, d + timedelta(days=3)][0] for s in range(1, 4)] == pytest.approx([1.5, 1.0, 0.75])


@pytest.mark.parametrize("name, most", [("al_alpha021_to_045", 5), ("al_alpha026_to_038", 2), ("al_alpha081_to_096", 4), ("al_alpha068_to_078", 4), ("al_alpha046_to_066", 2), ("al_alpha009_to_016", 4), ("al_alpha040_to_050", 5), ("al_alpha098_to_099", 4)])
def test_rows_move_once_for_each_change_of_key(spark, sf_dir, name, most):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= most and "Window" not in plan
