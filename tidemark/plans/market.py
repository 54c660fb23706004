"""Bars, resampling and time alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars
from tidemark.plans.register import query
from tidemark.sources import views
from tidemark.sources.views import HOURLY, TICKS, bars_sql

_BAR = "symbol, ts, open, high, low, close, volume, trade_count, buy_qty, sell_qty, taker_buy_ratio"


@query("io01_tick_range", f"WITH {TICKS} SELECT symbol, ts, seq, price, volume, side FROM ticks WHERE symbol = 'click' AND ts >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 60 MINUTE AND ts < TIMESTAMP '2024-01-09 00:00:00'")
def _(spark, d):
    t = views.ticks(spark, d)
    return t.where("symbol = 'click' AND ts >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 60 MINUTES AND ts < TIMESTAMP '2024-01-09 00:00:00'")


@query("io03_second_rows", f"""WITH {TICKS} SELECT symbol, date_trunc('second', ts) AS second, arg_max(price, (ts, seq)) AS last, max(price) AS high, min(price) AS low, sum(CASE WHEN side = 1 THEN volume ELSE 0 END) AS buy_qty,
sum(CASE WHEN side = -1 THEN volume ELSE 0 END) AS sell_qty, count(*) AS n_trades, sum(price * volume) / sum(volume) AS vwap FROM ticks GROUP BY 1, 2""")
def _(spark, d):
    return views.ticks(spark, d).groupBy("symbol", F.date_trunc("second", "ts").alias("second")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum(F.when(F.col("side") == 1, F.col("volume")).otherwise(0)).alias("buy_qty"),
        F.sum(F.when(F.col("side") == -1, F.col("volume")).otherwise(0)).alias("sell_qty"), F.count("*").alias("n_trades"), (F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("vwap"))


@query("br01_bars_hourly", f"WITH {HOURLY} SELECT {_BAR} FROM bars")
def _(spark, d):
    return views.hourly(spark, d)


@query("br01_bars_15m", f"WITH {TICKS}, {bars_sql('b15', '15 minutes')} SELECT {_BAR} FROM b15")
def _(spark, d):
    return bars.from_ticks(views.ticks(spark, d), "15 minutes")


_COARSE = """coarse AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS t, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS trade_count,
sum(buy_qty) AS buy_qty, sum(sell_qty) AS sell_qty, avg(taker_buy_ratio) AS taker_buy_ratio FROM bars GROUP BY 1, 2)"""


@query("br02_bars_4h", f"WITH {HOURLY}, {_COARSE} SELECT symbol, t AS ts, open, high, low, close, volume, trade_count, buy_qty, sell_qty, taker_buy_ratio FROM coarse")
def _(spark, d):
    return bars.coarser(views.hourly(spark, d), "4 hours")


_CVD = ", ".join(
    f"sum(delta) OVER w{n} AS cvd_{n}, CASE WHEN sum(flow) OVER w{n} > 0 THEN sum(delta) OVER w{n} / sum(flow) OVER w{n} ELSE 0 END AS cvd_{n}_norm" for n in (5, 20, 60, 288)
)
_CVD_W = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 20, 60, 288))


@query("br03_cvd", f"WITH {HOURLY}, b AS (SELECT symbol, ts, buy_qty - sell_qty AS delta, buy_qty + sell_qty AS flow FROM bars) SELECT symbol, ts, delta, sum(delta) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cvd, {_CVD} FROM b WINDOW {_CVD_W}")
def _(spark, d):
    made = bars.with_cvd(views.hourly(spark, d))
    return made.select("symbol", "ts", "delta", "cvd", *(f"cvd_{n}{x}" for n in (5, 20, 60, 288) for x in ("", "_norm")))


@query("br04_weekly_bars", f"""WITH {HOURLY} SELECT symbol, CAST(CAST(ts AS DATE) + CAST((7 - isodow(ts)) AS INTEGER) AS DATE) AS week_end, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""")
def _(spark, d):
    return bars.weekly(views.hourly(spark, d))


@query("br05_daily_regime", f"""WITH {HOURLY}, days AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2), r AS (SELECT *, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY day) - 1 AS roc FROM days)
SELECT *, CASE WHEN roc >= 0.15 THEN 'bull' WHEN roc <= -0.15 THEN 'bear' WHEN roc IS NOT NULL THEN 'neutral' END AS regime FROM r""")
def _(spark, d):
    return bars.daily_regime(views.hourly(spark, d), lookback=5)


@query("br07_br08_known_and_fill", f"WITH {HOURLY} SELECT symbol, ts, ts + INTERVAL 1 HOUR AS known_at, lead(open) OVER (PARTITION BY symbol ORDER BY ts) AS fill_price FROM bars")
def _(spark, d):
    return bars.with_next_open(views.hourly(spark, d), "1 HOUR")


BUCKETS = """run AS (SELECT *, sum(volume) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS upto FROM ticks),
parts AS (SELECT symbol, ts, side, upto, upto - volume AS start, unnest(range(CAST(floor((upto - volume) / 500) AS BIGINT), CAST(ceil(upto / 500) AS BIGINT))) AS bucket FROM run),
p AS (SELECT symbol, ts, side, bucket, least(upto, (bucket + 1) * 500) - greatest(start, bucket * 500) AS part FROM parts),
g AS (SELECT symbol, bucket, sum(CASE WHEN side = 1 THEN part ELSE 0 END) AS buy, sum(CASE WHEN side = -1 THEN part ELSE 0 END) AS sell, max(ts) AS ended FROM p GROUP BY 1, 2),
f AS (SELECT *, abs(buy - sell) / 500 AS imbalance FROM g WHERE buy + sell >= 500 * (1 - 1e-9))"""


@query("br09_vpin_buckets", f"WITH {TICKS}, {BUCKETS} SELECT symbol, bucket, buy, sell, ended, imbalance, avg(imbalance) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS vpin FROM f")
def _(spark, d):
    return bars.vpin(views.ticks(spark, d), 500.0, 50)


@query("br10_sessions", f"""WITH {HOURLY} SELECT symbol, ts, CASE WHEN hour(ts) < 8 THEN 'asia' WHEN hour(ts) < 14 THEN 'eu' WHEN hour(ts) < 21 THEN 'us' ELSE 'late' END AS session, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos FROM bars""")
def _(spark, d):
    turn = 2 * F.pi() * F.hour("ts") / 24
    return views.hourly(spark, d).select("symbol", "ts", bars.session(F.col("ts")).alias("session"), F.sin(turn).alias("hour_sin"), F.cos(turn).alias("hour_cos"))


@query("br11_io13_months_missing", f"""WITH {views.DAILY}, m AS (SELECT DISTINCT symbol, date_trunc('month', date) AS month FROM daily), g AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS month)
SELECT s.symbol, g.month FROM (SELECT DISTINCT symbol FROM daily) s CROSS JOIN g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.symbol = s.symbol AND CAST(m.month AS DATE) = g.month)""")
def _(spark, d):
    from tidemark.operators.quality import missing

    daily = views.daily(spark, d)
    present = daily.select("symbol", F.trunc("date", "month").alias("month"))
    expected = daily.select("symbol").distinct().crossJoin(F.broadcast(bars.month_grid("1995-01-01", "2001-12-01", spark)))  # 84 months
    return missing(expected, present, ["symbol", "month"])
