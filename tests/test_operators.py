"""Hand cases and the closed-bar rule."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import catalog
from tidemark.functions.frames import Frames, correlation
from tidemark.operators import bars, joins, labels, panels, quality, rules, stats

AT = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
FR = Frames(("symbol",), ("ts",))


def path_bars(spark, rows):
    return spark.createDataFrame([("a", AT + k * HOUR, *map(float, r)) for k, r in enumerate(rows)], "symbol string, ts timestamp, open double, high double, low double, close double, atr double")


def test_same_bar_stop_and_target_is_a_stop(spark):
    b = path_bars(spark, [(100, 100, 100, 100, 1), (100, 102, 98, 100, 1), (100, 100, 100, 100, 1)])
    got = [(r.barrier, r.meta) for r in labels.triple_barrier(b, FR, horizon=2).orderBy("ts").collect()]
    assert got == [(-1, 0), (None, None), (None, None)]
    assert labels.risk_reward(b, FR, horizon=2).orderBy("ts").first().rr_label == 0


def test_timeout_is_zero(spark):
    b = path_bars(spark, [(100, 100, 100, 100, 5)] * 4)
    assert [(r.barrier, r.meta) for r in labels.triple_barrier(b, FR, horizon=2).orderBy("ts").collect()][:2] == [(0, 0), (0, 0)]


def test_book_return_is_entered_after_the_close(spark):
    opens = [10.0, 11.0, 12.0, 15.0, 9.0]
    d = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(k), o, o, 1.0) for k, o in enumerate(opens)], "symbol string, date date, open double, close double, amount double")
    got = [r.book_ret for r in panels.with_factors(d, 2, 2).orderBy("date").collect()]
    assert got[:3] == pytest.approx([12 / 11 - 1, 15 / 12 - 1, 9 / 15 - 1]) and got[3:] == [None, None]


def test_funding_counts_after_entry_up_to_exit(spark):
    t = spark.createDataFrame([(1, AT, AT + 16 * HOUR)], "k int, entry timestamp, exit_at timestamp")
    p = spark.createDataFrame([(AT, 0.5), (AT + 8 * HOUR, 0.0001), (AT + 16 * HOUR, 0.0002), (AT + 17 * HOUR, 0.7)], "ts timestamp, rate double")
    assert joins.interval_sum(t, p, "entry", "exit_at", "ts", "rate", "paid").first().paid == pytest.approx(0.0003)


def test_half_rotation_turnover(spark):
    w = spark.createDataFrame([("2024-01-01", "x", 0.5), ("2024-01-01", "y", 0.5), ("2024-01-03", "x", 0.5), ("2024-01-03", "z", 0.5)], "date string, name string, weight double")
    assert [(r.date, r.turnover) for r in panels.turnover(w, "name").collect()] == [("2024-01-03", 0.5)]


def test_asof_ties_order_and_tolerance(spark):
    left = spark.createDataFrame([("a", AT, 1), ("a", AT + HOUR, 2), ("a", AT + 5 * HOUR, 3), ("b", AT, 4)], "symbol string, ts timestamp, k int")
    right = spark.createDataFrame([("a", AT, 1, 10.0), ("a", AT, 2, 20.0), ("a", AT + 2 * HOUR, 3, None)], "symbol string, at timestamp, seq int, v double")
    got = {r.k: (r.v, r.seq) for r in joins.asof(left, right, ["symbol"], "ts", "at", ["v", "seq"], "seq").collect()}
    assert got == {1: (20.0, 2), 2: (20.0, 2), 3: (None, 3), 4: (None, None)}
    near = {r.k: r.seq for r in joins.asof(left, right, ["symbol"], "ts", "at", ["seq"], "seq", "2 HOURS").collect()}
    assert near == {1: 2, 2: 2, 3: None, 4: None}


def test_bars_split_buckets_and_no_rows(spark):
    t = spark.createDataFrame([("a", AT, 0, 10.0, 7.0, 1), ("a", AT + HOUR, 1, 11.0, 8.0, -1), ("a", AT + 2 * HOUR, 2, 9.0, 5.0, 1)], "symbol string, ts timestamp, seq long, price double, volume double, side int")
    got = [(r.bucket, r.buy, r.sell) for r in bars.volume_buckets(t, 5.0).orderBy("bucket").collect()]
    assert got == [(0, 5.0, 0.0), (1, 2.0, 3.0), (2, 0.0, 5.0), (3, 5.0, 0.0)]
    assert bars.from_ticks(t.where("false"), "1 hour").count() == 0


def test_appending_future_rows_changes_no_feature(spark):
    rng = np.random.default_rng(0)
    rows = [("a", AT + k * HOUR, float(x), float(v)) for k, (x, v) in enumerate(zip(100 + rng.normal(size=80).cumsum(), rng.uniform(1, 9, 80)))]
    schema = "symbol string, ts timestamp, close double, volume double"
    made = lambda r: spark.createDataFrame(r, schema).select("ts", FR.zscore("close", 10).alias("z"), FR.rank_in_history("close", 10).alias("p"), FR.robust_z("volume", 10).alias("r"), FR.corr("close", "volume", 10).alias("c"), FR.quantile("close", 10, 0.9).alias("q"), FR.drawdown("close").alias("d"))
    short = {r.ts: tuple(r) for r in made(rows[:60]).collect()}
    long = {r.ts: tuple(r) for r in made(rows).collect()}
    assert all(long[k] == v for k, v in short.items())


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert df.agg(correlation("a", "b").alias("c")).first().c is None


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, -5.0, 1.0), (3, 0.0, -1.0)], "k int, x double, y double")
    one = lambda c: [r.c for r in df.select("k", c.alias("c")).orderBy("k").collect()]
    assert one(rules.predicate("abs(x) >= 5 AND y > 0", ["x", "y"])) == [False, True, False]
    assert one(rules.vote([("x", "sign", 0), ("y", "sign", 0)], consensus=True)) == [1.0, 0.0, -1.0]
    assert one(rules.vote([("x", "sign", 0), ("y", "negate_sign", 0)])) == [1.0, -1.0, 1.0]
    deny = [{"phase": "guardrail", "tag": "b", "when": {"feature": "x", "op": ">=", "value": 0}}, {"phase": "system_safety", "tag": "a", "when": {"feature": "y", "op": "<", "value": 0}}]
    assert one(rules.deny_tag(deny)) == ["b", None, "a"]
    with pytest.raises(ValueError):
        rules.predicate("z > 1", ["x"])


def test_quality_and_catalog(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 3.0), ("a", 3, None)], "symbol string, ts int, x double")
    assert [r.x for r in quality.filled(df, "x", FR, "ffill").orderBy("ts").collect()] == [None, 3.0, 3.0]
    assert [r.x for r in quality.filled(df, "x", FR, "bfill").orderBy("ts").collect()] == [3.0, 3.0, None]
    assert stats.area_under_curve(df.withColumn("y", F.col("ts") == 2), ["symbol"], "x", "y").first().auc is None
    catalog.add("t_twice", "test", ["t_base"], lambda: F.col("t_base") * 2)
    catalog.add("t_base", "test", ["ts"], lambda: F.col("ts") + 1)
    assert [r.t_twice for r in catalog.with_features(df, ["t_twice"]).orderBy("ts").collect()] == [4, 6, 8]
    catalog.add("t_loop", "test", ["t_loop2"], lambda: F.lit(1))
    catalog.add("t_loop2", "test", ["t_loop"], lambda: F.lit(1))
    with pytest.raises(ValueError):
        catalog.needed(["t_loop"], ["ts"])
    for name in ("t_twice", "t_base", "t_loop", "t_loop2"):
        del catalog._features[name]
