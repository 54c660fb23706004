"""Stores, bursts, cohorts, timing, footprints, candles and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Frames, correlation
from tidemark.operators.bars import BY_TIME as f
from tidemark.operators.panels import BY_DAY
from tidemark.plans.cross_section import _FACTORS, _IC
from tidemark.plans.register import query
from tidemark.plans.windows import _full, _S, _w
from tidemark.sources import store, views
from tidemark.sources.views import DAILY, HOURLY, SCAN, TICKS, TRADES
from tidemark.streaming.run import scratch

_PARTS = """a AS (SELECT symbol, ts, close, volume FROM bars WHERE day(ts) <= 20), b AS (SELECT symbol, ts, close + 1 AS close, CASE WHEN trade_count > 1 THEN trade_count END AS trade_count FROM bars WHERE day(ts) >= 15)"""


@query("io07_io08_io10_feature_store", f"""WITH {HOURLY}, {_PARTS} SELECT symbol, ts, CASE WHEN b.ts IS NOT NULL THEN b.close ELSE a.close END AS close, a.volume, b.trade_count FROM a FULL JOIN b USING (symbol, ts)
WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-02-05' AND symbol IN ('click', 'view')""")
def _(spark, d):
    h = views.hourly(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark, "layer")
    store.write_layer(h.where("day(ts) <= 20").select("symbol", "ts", "close", "volume"), path)
    old = spark.read.parquet(path).drop("month")
    new = h.where("day(ts) >= 15").select("symbol", "ts", (F.col("close") + 1).alias("close"), F.when(F.col("trade_count") > 1, F.col("trade_count")).alias("trade_count"))
    second = scratch(spark, "layer")
    store.write_layer(store.merged(old, new), second)
    return store.read_range(spark, second, "2024-01-10 00:00:00", "2024-02-05 00:00:00", ["close", "volume", "trade_count"], ["click", "view"])


@query("io12_layer_health", f"WITH {HOURLY}, x AS (SELECT symbol, strftime(ts, '%Y-%m') AS month, close, CASE WHEN symbol <> 'click' THEN volume END AS volume FROM bars) SELECT symbol, month, count(*) AS n, CAST(count(close) > 0 AS INTEGER) + CAST(count(volume) > 0 AS INTEGER) AS columns_present FROM x GROUP BY 1, 2")
def _(spark, d):
    return store.health(views.hourly(spark, d).select("symbol", "ts", "close", F.when(F.col("symbol") != "click", F.col("volume")).alias("volume")))


_BURST = f"""m AS (SELECT symbol, ts, close, volume, close / lag(close) OVER ({_S}) - 1 AS ret, lead(close, 1) OVER ({_S}) / close - 1 AS after_1, lead(close, 6) OVER ({_S}) / close - 1 AS after_6, quantile_cont(volume, 0.9) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS p90, count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS k FROM bars),
u AS (SELECT symbol, ts, sign(ret) AS side, 1e4 * sign(ret) * after_1 AS bp_1, 1e4 * sign(ret) * after_6 AS bp_6 FROM m WHERE k = 24 AND volume >= p90 AND abs(ret) >= 0.02)"""


@query("pf25_pf26_bursts_markout", f"WITH {HOURLY}, {_BURST} SELECT * FROM u")
def bursts(spark, d):
    """Bars with unusual volume and movement, and what followed in the direction of the move, in basis points."""
    before = f.before(24)
    rows = views.hourly(spark, d).withColumns({"ret": f.change("close"), "after_1": f.lead("close", 1) / F.col("close") - 1, "after_6": f.lead("close", 6) / F.col("close") - 1, "p90": F.percentile("volume", F.lit(0.9)).over(before), "k": F.count("*").over(before)})
    rows = rows.where((F.col("k") == 24) & (F.col("volume") >= F.col("p90")) & (F.abs("ret") >= 0.02))
    side = F.signum("ret")
    return rows.select("symbol", "ts", side.alias("side"), (1e4 * side * F.col("after_1")).alias("bp_1"), (1e4 * side * F.col("after_6")).alias("bp_6"))


@query("pf27_markout_summary", f"WITH {HOURLY}, {_BURST} SELECT coalesce(symbol, 'all') AS sleeve, count(*) AS n, avg(bp_1) - 5 AS net_1, avg(bp_6) - 5 AS net_6, avg(CASE WHEN bp_6 > 5 THEN 1.0 ELSE 0.0 END) AS won FROM u GROUP BY ROLLUP (symbol)")
def _(spark, d):
    g = bursts(spark, d).rollup("symbol").agg(F.count("*").alias("n"), (F.avg("bp_1") - 5).alias("net_1"), (F.avg("bp_6") - 5).alias("net_6"), F.avg(F.when(F.col("bp_6") > 5, 1.0).otherwise(0.0)).alias("won"))
    return g.select(F.coalesce("symbol", F.lit("all")).alias("sleeve"), "n", "net_1", "net_6", "won")


@query("fx055_rm19_footprint", f"""WITH {TICKS}, b AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS bar, CAST(floor(price / 10) AS BIGINT) AS bin, sum(volume) AS volume, sum(side * volume) AS delta FROM ticks GROUP BY 1, 2, 3)
SELECT symbol, bar, arg_min(bin, (-volume, bin)) * 10 + 5 AS poc, arg_min(delta, (-volume, bin)) AS delta_at_poc, sum(delta) / sum(volume) AS imbalance, max(volume) / sum(volume) AS concentration, count(*) AS levels FROM b GROUP BY 1, 2""")
def _(spark, d):
    t = views.ticks(spark, d)
    b = t.groupBy("symbol", F.window("ts", "4 hours")["start"].alias("bar"), F.floor(F.col("price") / 10).alias("bin")).agg(F.sum("volume").alias("volume"), F.sum(F.col("side") * F.col("volume")).alias("delta"))
    top = F.struct((-F.col("volume")).alias("minus"), "bin")
    return b.groupBy("symbol", "bar").agg((F.min_by("bin", top) * 10 + 5).alias("poc"), F.min_by("delta", top).alias("delta_at_poc"), (F.sum("delta") / F.sum("volume")).alias("imbalance"), (F.max("volume") / F.sum("volume")).alias("concentration"), F.count("*").alias("levels"))


@query("xf05_candles", f"""WITH {HOURLY}, x AS (SELECT *, abs(close - open) AS body, high - low AS span, high - greatest(open, close) AS up, least(open, close) - low AS down, lag(open) OVER ({_S}) AS o1, lag(close) OVER ({_S}) AS c1 FROM bars)
SELECT symbol, ts, CASE WHEN span > 0 AND body <= 0.1 * span THEN 100 ELSE 0 END AS doji, CASE WHEN span > 0 AND down >= 2 * body AND up <= 0.1 * span AND body > 0 THEN 100 ELSE 0 END AS hammer, CASE WHEN span > 0 AND up >= 2 * body AND down <= 0.1 * span AND body > 0 THEN -100 ELSE 0 END AS shooting_star,
CASE WHEN c1 < o1 AND close > open AND open <= c1 AND close >= o1 THEN 100 WHEN c1 > o1 AND close < open AND open >= c1 AND close <= o1 THEN -100 ELSE 0 END AS engulfing, CASE WHEN span > 0 AND body >= 0.95 * span THEN CAST(sign(close - open) AS INTEGER) * 100 ELSE 0 END AS marubozu FROM x""")
def _(spark, d):
    o, c = F.col("open"), F.col("close")
    x = views.hourly(spark, d).withColumns({"body": F.abs(c - o), "span": F.col("high") - F.col("low"), "up": F.col("high") - F.greatest(o, c), "down": F.least(o, c) - F.col("low"), "o1": f.lag("open"), "c1": f.lag("close")})
    some = F.col("span") > 0
    return x.select(
        "symbol", "ts", F.when(some & (F.col("body") <= 0.1 * F.col("span")), 100).otherwise(0).alias("doji"), F.when(some & (F.col("down") >= 2 * F.col("body")) & (F.col("up") <= 0.1 * F.col("span")) & (F.col("body") > 0), 100).otherwise(0).alias("hammer"),
        F.when(some & (F.col("up") >= 2 * F.col("body")) & (F.col("down") <= 0.1 * F.col("span")) & (F.col("body") > 0), -100).otherwise(0).alias("shooting_star"),
        F.when((F.col("c1") < F.col("o1")) & (c > o) & (o <= F.col("c1")) & (c >= F.col("o1")), 100).when((F.col("c1") > F.col("o1")) & (c < o) & (o >= F.col("c1")) & (c <= F.col("o1")), -100).otherwise(0).alias("engulfing"),
        F.when(some & (F.col("body") >= 0.95 * F.col("span")), F.signum(c - o).cast("int") * 100).otherwise(0).alias("marubozu"))


_COHORT = """c AS (SELECT symbol, year(date) AS vintage, min(date) AS entry, arg_min(close, date) AS entry_close FROM daily GROUP BY 1, 2), h AS (SELECT c.vintage, c.symbol, any_value(c.entry_close) AS entry_close, max(d.date) AS last_day, arg_max(d.close, d.date) AS last_close FROM c JOIN daily d ON d.symbol = c.symbol AND d.date >= c.entry AND d.date <= c.entry + INTERVAL 3 YEAR GROUP BY 1, 2),
m AS (SELECT vintage, symbol, last_close / entry_close AS multiple, row_number() OVER (PARTITION BY vintage ORDER BY last_close / entry_close DESC, symbol) AS k FROM h)"""


@query("pf09_pf10_cohorts", f"WITH {DAILY}, {_COHORT} SELECT vintage, count(*) AS names, avg(multiple) AS mean_multiple, median(multiple) AS median_multiple, avg(CASE WHEN multiple > 1 THEN 1.0 ELSE 0.0 END) AS won, count(*) FILTER (multiple >= 2) AS hit_2x, avg(multiple) FILTER (k > 3) AS without_top3 FROM m GROUP BY vintage")
def _(spark, d):
    daily = views.daily(spark, d).select("symbol", "date", "close")
    c = daily.groupBy("symbol", F.year("date").alias("vintage")).agg(F.min("date").alias("entry"), F.min_by("close", "date").alias("entry_close"))
    # held days of a vintage lie in its own year and the three that follow: an equi join on symbol and year
    held = c.withColumn("year", F.explode(F.sequence(F.col("vintage"), F.col("vintage") + 3)))
    days = daily.withColumn("year", F.year("date")).join(held, ["symbol", "year"]).where((F.col("date") >= F.col("entry")) & (F.col("date") <= F.add_months("entry", 36)))
    m = days.groupBy("vintage", "symbol").agg((F.max_by("close", "date") / F.first("entry_close")).alias("multiple"))
    m = m.withColumn("k", F.row_number().over(Window.partitionBy("vintage").orderBy(F.desc("multiple"), "symbol")))
    return m.groupBy("vintage").agg(F.count("*").alias("names"), F.avg("multiple").alias("mean_multiple"), F.percentile("multiple", F.lit(0.5)).alias("median_multiple"), F.avg(F.when(F.col("multiple") > 1, 1.0).otherwise(0.0)).alias("won"), F.count(F.when(F.col("multiple") >= 2, 1)).alias("hit_2x"), F.avg(F.when(F.col("k") > 3, F.col("multiple"))).alias("without_top3"))


@query("pf11_pf12_timing", f"""WITH {DAILY}, s AS (PARTITION_BY), x AS (SELECT symbol, date, close, close / lag(close) OVER s - 1 AS ret, close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1 AS dd, CASE WHEN count(close) OVER w >= 50 THEN avg(close) OVER w END AS ma FROM daily WINDOW s AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, coalesce(max(CASE WHEN dd <= -0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS dip_hold, lag(CAST(close > ma AS INTEGER)) OVER (PARTITION BY symbol ORDER BY date) AS above, last_value(CASE WHEN close > 1.3 * ma THEN 1 WHEN close < 0.7 * ma THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS state FROM x)
SELECT symbol, date, dip_hold, dip_hold * ret AS dip_ret, coalesce(above, 0) * ret AS ma_ret, state FROM y""".replace("s AS (PARTITION_BY), ", ""))
def _(spark, d):
    g = BY_DAY
    x = views.daily(spark, d).select("symbol", "date", "close", g.change("close").alias("ret"), (F.col("close") / F.max("close").over(g.past(60)) - 1).alias("dd"), g.mean("close", 50).alias("ma"))
    dip = F.coalesce(F.max(F.when(F.col("dd") <= -0.5, 1).otherwise(0)).over(g.before(20)), F.lit(0))
    event = F.when(F.col("close") > 1.3 * F.col("ma"), 1).when(F.col("close") < 0.7 * F.col("ma"), -1)
    y = x.withColumns({"dip_hold": dip, "above": g.lag((F.col("close") > F.col("ma")).cast("int")), "state": F.last(event, ignorenulls=True).over(g.so_far)})
    return y.select("symbol", "date", "dip_hold", (F.col("dip_hold") * F.col("ret")).alias("dip_ret"), (F.coalesce("above", F.lit(0)) * F.col("ret")).alias("ma_ret"), "state")


@query("pr14_pr15_regime_router", f"""WITH {HOURLY}, x AS (SELECT symbol, ts, abs(close - lag(close, 10) OVER ({_S})) AS net, CASE WHEN count(*) OVER {_w(10)} >= 10 THEN avg(high - low) OVER {_w(10)} END AS span, stddev_samp(close) OVER {_w(10)} AS sd FROM bars), y AS (SELECT *, net / (10 * span) AS efficiency FROM x WHERE span > 0)
SELECT symbol, ts, efficiency, CASE WHEN sd > 30 THEN 'no_trade' WHEN efficiency >= 0.15 THEN 'trend' WHEN efficiency <= 0.05 THEN 'mean' ELSE 'no_trade' END AS mode FROM y WHERE net IS NOT NULL""")
def _(spark, d):
    x = views.hourly(spark, d).select("symbol", "ts", F.abs(f.delta("close", 10)).alias("net"), f.mean(F.col("high") - F.col("low"), 10).alias("span"), F.stddev_samp("close").over(f.past(10)).alias("sd"))
    y = x.where("span > 0 AND net IS NOT NULL").withColumn("efficiency", F.col("net") / (10 * F.col("span")))
    mode = F.when(F.col("sd") > 30, "no_trade").when(F.col("efficiency") >= 0.15, "trend").when(F.col("efficiency") <= 0.05, "mean").otherwise("no_trade")
    return y.select("symbol", "ts", "efficiency", mode.alias("mode"))


@query("sk13_ic_drift", f"""WITH {DAILY}, {_FACTORS}, {_IC}, y AS (SELECT year(date) AS year, avg(ic) AS ic FROM ic GROUP BY 1), b AS (SELECT ic AS base FROM y WHERE year = 1995) SELECT year, ic, ic - base AS drift, sign(round(ic, 6)) <> sign(round(base, 6)) AS flipped FROM y, b""")
def _(spark, d):
    from tidemark.operators import panels

    y = panels.daily_ic(panels.with_factors(views.daily(spark, d)), "mom", "fwd").groupBy(F.year("date").alias("year")).agg(F.avg("ic").alias("ic"))
    base = F.broadcast(y.where("year = 1995").select(F.col("ic").alias("base")))  # one row
    return y.crossJoin(base).select("year", "ic", (F.col("ic") - F.col("base")).alias("drift"), (F.signum(F.round("ic", 6)) != F.signum(F.round("base", 6))).alias("flipped"))


@query("sk19_sk27_group_effects", f"""WITH {SCAN}, g AS (SELECT symbol % 10 AS leaf, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.75) AS p75 FROM scan GROUP BY 1), a AS (SELECT avg(r) AS m, stddev_samp(r) AS s FROM scan) SELECT leaf, n, mean, (mean - m) / s AS effect, p25, p75, CASE WHEN (mean - m) / s < -0.01 THEN 'worse' WHEN (mean - m) / s > 0.01 THEN 'better' ELSE 'same' END AS class FROM g, a""")
def _(spark, d):
    rows = views.scan(spark, d)
    whole = F.broadcast(rows.agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s")))  # one row
    g = rows.groupBy((F.col("symbol") % 10).alias("leaf")).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.percentile("r", F.lit(0.25)).alias("p25"), F.percentile("r", F.lit(0.75)).alias("p75")).crossJoin(whole)
    effect = (F.col("mean") - F.col("m")) / F.col("s")
    return g.select("leaf", "n", "mean", effect.alias("effect"), "p25", "p75", F.when(effect < -0.01, "worse").when(effect > 0.01, "better").otherwise("same").alias("class"))


@query("sk22_kpi_gates", f"""WITH {TRADES}, k AS (SELECT symbol, avg(pnl_r) AS mean_r, avg(CASE WHEN pnl_r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM trades GROUP BY 1), l AS (SELECT symbol, 'mean_r' AS metric, mean_r AS value, -0.01 AS lowest, NULL::DOUBLE AS highest FROM k UNION ALL SELECT symbol, 'win_rate', win_rate, 0.4, 0.5 FROM k)
SELECT symbol, metric, value, (lowest IS NULL OR value >= lowest) AND (highest IS NULL OR value <= highest) AS passed FROM l""")
def _(spark, d):
    k = views.trades(spark, d).groupBy("symbol").agg(F.avg("pnl_r").alias("mean_r"), F.avg(F.when(F.col("pnl_r") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    gates = spark.sql("SELECT * FROM VALUES ('mean_r', -0.01D, CAST(NULL AS DOUBLE)), ('win_rate', 0.4D, 0.5D) AS t(metric, lowest, highest)")
    long = k.unpivot("symbol", ["mean_r", "win_rate"], "metric", "value").join(F.broadcast(gates), "metric")  # a row a gate
    inside = (F.col("lowest").isNull() | (F.col("value") >= F.col("lowest"))) & (F.col("highest").isNull() | (F.col("value") <= F.col("highest")))
    return long.select("symbol", "metric", "value", inside.alias("passed"))


@query("ag05_pf22_exposure", f"""WITH {TRADES}, d AS (SELECT entry_time AS day, symbol, sum(CASE WHEN side = 'long' THEN abs(pnl_r) ELSE 0 END) AS long_notional, sum(CASE WHEN side = 'short' THEN abs(pnl_r) ELSE 0 END) AS short_notional FROM trades GROUP BY 1, 2) SELECT day, symbol, long_notional, short_notional, long_notional + short_notional AS gross, long_notional - short_notional AS net, (long_notional + short_notional) / 3 > 2 AS over_limit FROM d""")
def _(spark, d):
    side = lambda s: F.sum(F.when(F.col("side") == s, F.abs("pnl_r")).otherwise(0))
    g = views.trades(spark, d).groupBy(F.col("entry_time").alias("day"), "symbol").agg(side("long").alias("long_notional"), side("short").alias("short_notional"))
    gross = F.col("long_notional") + F.col("short_notional")
    return g.select("day", "symbol", "long_notional", "short_notional", gross.alias("gross"), (F.col("long_notional") - F.col("short_notional")).alias("net"), (gross / 3 > 2).alias("over_limit"))


@query("xf15_sk03_rolling_correlation", f"""WITH {HOURLY}, r AS (SELECT symbol, ts, buy_qty - sell_qty AS d, close / lag(close) OVER ({_S}) - 1 AS ret FROM bars), x AS (SELECT symbol, ts, CASE WHEN count(ret) OVER {_w(30)} >= 30 AND stddev_pop(d) OVER {_w(30)} > 0 AND stddev_pop(ret) OVER {_w(30)} > 0 THEN round(corr(d, ret) OVER {_w(30)}, 9) END AS c FROM r)
SELECT symbol, count(c) AS n, avg(c) AS mean, stddev_samp(c) AS sd, avg(c) / stddev_samp(c) AS ir, avg(CASE WHEN c > 0 THEN 1.0 WHEN c IS NOT NULL THEN 0.0 END) AS positive FROM x GROUP BY symbol""")
def _(spark, d):
    r = views.hourly(spark, d).select("symbol", "ts", (F.col("buy_qty") - F.col("sell_qty")).alias("d"), f.change("close").alias("ret"))
    c = F.when(F.count("ret").over(f.past(30)) >= 30, F.round(correlation("d", "ret", f.past(30)), 9))
    x = r.select("symbol", c.alias("c"))
    return x.groupBy("symbol").agg(F.count("c").alias("n"), F.avg("c").alias("mean"), F.stddev_samp("c").alias("sd"), (F.avg("c") / F.stddev_samp("c")).alias("ir"), F.avg(F.when(F.col("c") > 0, 1.0).when(F.col("c").isNotNull(), 0.0)).alias("positive"))


@query("dq14_health", f"""WITH {HOURLY}, x AS (SELECT symbol, ts, close, lag(close) OVER ({_S}) AS before, ts - lag(ts) OVER ({_S}) AS gap FROM bars) SELECT symbol, count(*) AS n, count(*) FILTER (gap > INTERVAL 1 HOUR) AS gaps, count(*) FILTER (close = before) AS stale, count(*) FILTER (close < 101 OR close > 199) AS out_of_range, max(ts) AS last_seen FROM x GROUP BY symbol""")
def _(spark, d):
    x = views.hourly(spark, d).select("symbol", "ts", "close", f.lag("close").alias("before"), (F.col("ts") > f.lag("ts") + F.expr("INTERVAL 1 HOUR")).alias("gap"))
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.count(F.when(F.col("gap"), 1)).alias("gaps"), F.count(F.when(F.col("close") == F.col("before"), 1)).alias("stale"), F.count(F.when((F.col("close") < 101) | (F.col("close") > 199), 1)).alias("out_of_range"), F.max("ts").alias("last_seen"))


@query("lb15_lb16_sweep_labels", f"""WITH {HOURLY}, x AS (SELECT symbol, ts, close, high, low, max(high) OVER p AS top, min(low) OVER p AS bottom, count(*) OVER p AS k, lead(close, 6) OVER ({_S}) / close - 1 AS fwd FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, ts, CASE WHEN high > top AND close < top THEN 'sweep_high' WHEN low < bottom AND close > bottom THEN 'sweep_low' WHEN close > top THEN 'breakout' WHEN close < bottom THEN 'breakdown' END AS signal, fwd FROM x WHERE k = 20 AND (high > top OR low < bottom)""")
def _(spark, d):
    p = f.before(20)
    x = views.hourly(spark, d).select("symbol", "ts", "close", "high", "low", F.max("high").over(p).alias("top"), F.min("low").over(p).alias("bottom"), F.count("*").over(p).alias("k"), (f.lead("close", 6) / F.col("close") - 1).alias("fwd"))
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    signal = F.when((h > F.col("top")) & (c < F.col("top")), "sweep_high").when((lo < F.col("bottom")) & (c > F.col("bottom")), "sweep_low").when(c > F.col("top"), "breakout").when(c < F.col("bottom"), "breakdown")
    return x.where((F.col("k") == 20) & ((h > F.col("top")) | (lo < F.col("bottom")))).select("symbol", "ts", signal.alias("signal"), "fwd")
