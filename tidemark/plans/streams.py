"""Streaming queries over the event file, and the batch SQL that they must equal once all input is read."""

from __future__ import annotations

from tidemark.plans.market import BUCKETS
from tidemark.plans.register import query
from tidemark.sources import store
from tidemark.sources.views import TICKS
from tidemark.streaming import operators, run

_END = "(SELECT max(ts) FROM events) - INTERVAL 2 MINUTE"


@query("st01_stream_bars", f"""WITH {TICKS}, b AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS t, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume, count(*) AS trade_count,
sum(CASE WHEN side = 1 THEN volume ELSE 0 END) AS buy_qty FROM ticks GROUP BY 1, 2) SELECT symbol, t AS ts, open, high, low, close, volume, trade_count, buy_qty FROM b WHERE t + INTERVAL 1 HOUR <= {_END}""")
def _(spark, d):
    return run.finished(operators.bars(run.ticks(spark, d), "1 hour"), "bars")


@query("st02_stream_flow", f"""WITH {TICKS}, w AS (SELECT symbol, side, volume, unnest(generate_series(time_bucket(INTERVAL '10 minutes', ts) - INTERVAL 20 MINUTE, time_bucket(INTERVAL '10 minutes', ts), INTERVAL 10 MINUTE)) AS t FROM ticks)
SELECT symbol, t AS ts, (sum(CASE WHEN side = 1 THEN volume ELSE 0 END) - sum(CASE WHEN side = -1 THEN volume ELSE 0 END)) / sum(volume) AS imbalance, count(*) AS n FROM w WHERE t + INTERVAL 30 MINUTE <= {_END} GROUP BY 1, 2""")
def _(spark, d):
    return run.finished(operators.flow(run.ticks(spark, d), "30 minutes", "10 minutes"), "flow")


@query("st07_stream_funnel", f"""WITH {TICKS} SELECT time_bucket(INTERVAL '15 minutes', ts) AS ts, symbol AS stage, count(*) AS "count" FROM ticks WHERE time_bucket(INTERVAL '15 minutes', ts) + INTERVAL 15 MINUTE <= {_END} GROUP BY 1, 2""")
def _(spark, d):
    return run.finished(operators.funnel(run.ticks(spark, d)), "funnel")


@query("st14_stream_sessions", f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM ticks), s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT symbol, min(ts) AS started, max(ts) + INTERVAL 10 MINUTE AS ended, count(*) AS n, sum(volume) AS volume FROM s GROUP BY symbol, k HAVING max(ts) + INTERVAL 10 MINUTE <= {_END}""")
def _(spark, d):
    return run.finished(operators.sessions(run.ticks(spark, d), "10 minutes"), "sessions")


@query("st12_stream_once_per_bucket", f"WITH {TICKS} SELECT DISTINCT symbol, time_bucket(INTERVAL '1 hour', ts) AS bucket FROM ticks")
def _(spark, d):
    return run.finished(operators.once_per_bucket(run.ticks(spark, d), "1 hour", "2 hours"), "once")


@query("st04_stream_runs", f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY symbol ORDER BY ts, seq) THEN 0 ELSE 1 END AS fresh FROM ticks), s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS k FROM g),
r AS (SELECT symbol, k, min(ts) AS started, any_value(side) AS side, CAST(count(*) AS INTEGER) AS n, sum(volume) AS volume FROM s GROUP BY symbol, k) SELECT symbol, started, side, n, volume FROM r WHERE k < (SELECT max(k) FROM r q WHERE q.symbol = r.symbol)""")
def _(spark, d):
    return run.finished(operators.runs(run.ticks(spark, d)), "runs")


@query("st05_stream_buckets", f"WITH {TICKS}, {BUCKETS} SELECT symbol, bucket, buy, sell, ended, imbalance FROM f")
def _(spark, d):
    return run.finished(operators.buckets(run.ticks(spark, d), 500.0), "buckets")


@query("st09_stream_ema", f"""WITH RECURSIVE {TICKS}, n AS (SELECT symbol, seq, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM ticks), e AS (SELECT symbol, seq, k, price AS ema FROM n WHERE k = 1
UNION ALL SELECT n.symbol, n.seq, n.k, e.ema + 2.0 / 21 * (n.price - e.ema) FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1) SELECT symbol, seq, ema FROM e""")
def _(spark, d):
    return run.finished(operators.smoothed(run.ticks(spark, d), 20), "ema")


@query("st03_st08_stream_to_store", f"""WITH {TICKS}, b AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS t, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close FROM ticks GROUP BY 1, 2),
c AS (SELECT symbol, t AS ts, open, high, low, close, close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY t) - 1 AS roc FROM b WHERE t + INTERVAL 1 HOUR <= {_END}) SELECT symbol, ts, close, roc FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")
def _(spark, d):
    """Closed bars go to the store trigger by trigger; live use reads a warm-up of its last rows and takes the newest feature row."""
    layer = run.scratch(spark, "bars")
    run.each_batch(operators.bars(run.ticks(spark, d), "1 hour").select("symbol", "ts", "open", "high", "low", "close"), "store", operators.merged_into(layer))
    return store.last_features(spark.read.parquet(layer).drop("month"), 4, {"roc": lambda f: f.change("close", 3)}).select("symbol", "ts", "close", "roc")
