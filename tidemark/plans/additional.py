"""More joins, sources and tables of the inventory."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import recursive
from tidemark.functions.frames import Frames
from tidemark.operators import bars, joins, stats
from tidemark.operators.bars import BY_TIME as f
from tidemark.operators.panels import BY_DAY
from tidemark.plans.register import query
from tidemark.plans.windows import _S, _w
from tidemark.sources import views
from tidemark.sources.views import DAILY, HOURLY, TICKS, TRADES, bars_sql
from tidemark.streaming.run import scratch


@query("io05_daily_panel", f"WITH {DAILY}, k AS (SELECT symbol, date, close, amount, count(*) OVER (PARTITION BY symbol) AS n FROM daily WHERE close > 0 AND amount > 0) SELECT symbol, date, close, amount FROM k WHERE n >= 43")
def _(spark, d):
    rows = views.daily(spark, d).select("symbol", "date", F.expr("try_cast(close AS double)").alias("close"), "amount").where("close > 0 AND amount > 0")
    last = rows.groupBy("symbol", "date").agg(F.max_by(F.struct("close", "amount"), "amount").alias("x")).select("symbol", "date", "x.close", "x.amount")
    return last.withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).where("n >= 43").drop("n")


@query("io14_event_calendar", """WITH e AS (SELECT CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS usd FROM events WHERE event_type = 'purchase' AND value >= 50 GROUP BY 1) SELECT day, usd, CASE WHEN count(*) OVER w >= 4 THEN usd > median(usd) OVER w END AS above FROM e WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    e = views.table(spark, d, "events").where("event_type = 'purchase' AND value >= 50").groupBy(F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("usd"))
    w = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return e.select("day", "usd", F.when(F.count("*").over(w) >= 4, F.col("usd") > F.percentile("usd", F.lit(0.5)).over(w)).alias("above"))


@query("io02_io16_csv_round_trip", f"WITH {TRADES} SELECT trade_id, symbol, side, entry_time, exit_time, pnl_r FROM trades WHERE pnl_r > 1")
def _(spark, d):
    path = scratch(spark, "trades-csv")
    t = views.trades(spark, d).where("pnl_r > 1")
    t.write.option("header", True).csv(path)
    return spark.read.schema(t.schema).option("header", True).csv(path)


@query("io17_json_logs", "SELECT event_type AS stage, event_id, user_id, value FROM events WHERE event_type IN ('click', 'error')")
def _(spark, d):
    path = scratch(spark, "logs-json")
    e = views.table(spark, d, "events").where("event_type IN ('click', 'error')").select(F.col("event_type").alias("stage"), "event_id", "user_id", "value")
    e.write.partitionBy("stage").json(path)
    return spark.read.schema("event_id long, user_id long, value double, stage string").json(path).select("stage", "event_id", "user_id", "value")


_SNAP = "snap AS (SELECT symbol, ts + INTERVAL 20 MINUTE AS at, close * 0.98 AS bid_wall, close * 1.03 AS ask_wall FROM bars WHERE hour(ts) % 6 = 0)"
_ATR14 = f"a AS (SELECT symbol, ts, close, CASE WHEN count(*) OVER {_w(14)} >= 14 THEN avg(high - low) OVER {_w(14)} END AS atr FROM bars)"


@query("jn03_walls_asof", f"WITH {HOURLY}, {_SNAP}, {_ATR14} SELECT a.symbol, a.ts, bid_wall, ask_wall, CASE WHEN atr > 0 THEN least(abs(close - bid_wall), abs(close - ask_wall)) / atr END AS wall_distance FROM a ASOF LEFT JOIN snap s ON a.symbol = s.symbol AND a.ts >= s.at")
def _(spark, d):
    h = views.hourly(spark, d)
    snap = h.where("hour(ts) % 6 = 0").select("symbol", (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("at"), (F.col("close") * F.lit(0.98)).alias("bid_wall"), (F.col("close") * F.lit(1.03)).alias("ask_wall"))
    a = h.select("symbol", "ts", "close", f.mean(F.col("high") - F.col("low"), 14).alias("atr"))
    j = joins.asof(a, snap, ["symbol"], "ts", "at", ["bid_wall", "ask_wall"])
    near = F.least(F.abs(F.col("close") - F.col("bid_wall")), F.abs(F.col("close") - F.col("ask_wall")))
    return j.select("symbol", "ts", "bid_wall", "ask_wall", F.when((F.col("atr") > 0) & F.col("bid_wall").isNotNull(), near / F.col("atr")).alias("wall_distance"))


@query("jn04_quarterly_asof", f"""WITH {DAILY}, q AS (SELECT CAST(date_trunc('quarter', date) AS DATE) AS quarter, sum(amount) AS spend FROM daily GROUP BY 1), k AS (SELECT CAST(quarter + INTERVAL 3 MONTH AS DATE) AS available_at, spend, spend / lag(spend) OVER (ORDER BY quarter) - 1 AS qoq FROM q)
SELECT d.symbol, d.date, k.spend, k.qoq FROM daily d ASOF LEFT JOIN k ON d.date >= k.available_at""")
def _(spark, d):
    daily = views.daily(spark, d)
    q = daily.groupBy(F.to_date(F.date_trunc("quarter", "date")).alias("quarter")).agg(F.sum("amount").alias("spend"))
    one = Window.partitionBy(F.lit(1)).orderBy("quarter")  # one row a quarter
    k = q.select(F.add_months("quarter", 3).alias("available_at"), "spend", (F.col("spend") / F.lag("spend").over(one) - 1).alias("qoq"))
    # known from its day on until the next one: a quarter's days meet it by an equi join on the day's own quarter
    return daily.withColumn("available_at", F.to_date(F.date_trunc("quarter", "date"))).join(F.broadcast(k), "available_at", "left").select("symbol", "date", "spend", "qoq")


@query("jn08_basket_zscore", f"""WITH {HOURLY}, z AS (SELECT symbol, ts, CASE WHEN count(*) OVER {_w(20)} >= 20 AND stddev_samp(close) OVER {_w(20)} > 0 THEN (close - avg(close) OVER {_w(20)}) / stddev_samp(close) OVER {_w(20)} END AS z FROM bars), b AS (SELECT ts, avg(z) AS basket, count(z) AS members FROM z WHERE symbol <> 'click' GROUP BY ts) SELECT h.symbol, h.ts, b.basket, b.members FROM bars h LEFT JOIN b USING (ts) WHERE h.symbol = 'click'""")
def _(spark, d):
    z = views.hourly(spark, d).select("symbol", "ts", f.zscore("close", 20).alias("z"))
    basket = z.where("symbol <> 'click'").groupBy("ts").agg(F.avg("z").alias("basket"), F.count("z").alias("members"))
    return z.where("symbol = 'click'").select("symbol", "ts").join(basket, "ts", "left").select("symbol", "ts", "basket", "members")


@query("jn09_leading_fill", f"""WITH {HOURLY}, x AS (SELECT symbol, ts, CASE WHEN hour(ts) = 12 THEN volume END AS cap FROM bars) SELECT symbol, ts, coalesce(last_value(cap IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING), first_value(cap IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS cap FROM x""")
def _(spark, d):
    x = views.hourly(spark, d).select("symbol", "ts", F.when(F.hour("ts") == 12, F.col("volume")).alias("cap"))
    whole = f.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return x.select("symbol", "ts", F.coalesce(f.filled("cap"), F.first("cap", ignorenulls=True).over(whole)).alias("cap"))


@query("jn15_latest_of_timeframes", f"""WITH {HOURLY}, {bars_sql('slow', '4 hours')}, q AS (SELECT symbol, ts + INTERVAL 30 MINUTE AS at FROM bars), o AS (SELECT symbol, ts + INTERVAL 1 HOUR AS known, close AS value, '1h' AS frame FROM bars UNION ALL SELECT symbol, ts + INTERVAL 4 HOUR, close, '4h' FROM slow),
u AS (SELECT symbol, known, arg_min(value, frame) AS value, min(frame) AS frame FROM o GROUP BY 1, 2) SELECT q.symbol, q.at, u.value, u.frame FROM q ASOF LEFT JOIN u ON q.symbol = u.symbol AND q.at >= u.known""")
def _(spark, d):
    h = views.hourly(spark, d)
    slow = bars.from_ticks(views.ticks(spark, d), "4 hours")
    of = lambda df, hours, frame: df.select("symbol", (F.col("ts") + F.expr(f"INTERVAL {hours} HOURS")).alias("known"), F.col("close").alias("value"), F.lit(frame).alias("frame"))
    both = of(h, 1, "1h").unionByName(of(slow, 4, "4h")).groupBy("symbol", "known").agg(F.min_by("value", "frame").alias("value"), F.min("frame").alias("frame"))
    at = h.select("symbol", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("at"))
    return joins.asof(at, both, ["symbol"], "at", "known", ["value", "frame"])


@query("jn10_jn11_log_joins", f"""WITH {HOURLY}, p AS (SELECT symbol, ts, close > open AS up FROM bars WHERE trade_count > 1), m AS (SELECT symbol, ts, 'busy' AS mode FROM bars WHERE trade_count >= 4) SELECT p.symbol, p.ts, p.up, m.mode, l.ret FROM p LEFT JOIN m USING (symbol, ts) JOIN (SELECT symbol, ts, lead(close) OVER ({_S}) / close - 1 AS ret FROM bars) l USING (symbol, ts)""")
def _(spark, d):
    h = views.hourly(spark, d)
    p = h.where("trade_count > 1").select("symbol", "ts", (F.col("close") > F.col("open")).alias("up"))
    m = h.where("trade_count >= 4").select("symbol", "ts", F.lit("busy").alias("mode"))
    l = h.select("symbol", "ts", (f.lead("close") / F.col("close") - 1).alias("ret"))
    return p.join(m, ["symbol", "ts"], "left").join(l, ["symbol", "ts"])


@query("tk05_best_lag", f"""WITH {HOURLY}, b AS (SELECT symbol, ts, volume, close / lag(close) OVER ({_S}) - 1 AS ret FROM bars), x AS (SELECT symbol, ret, {', '.join(f'lag(volume, {k}) OVER ({_S}) AS lag_{k}' for k in (1, 2, 3, 4))} FROM b), l AS (UNPIVOT x ON lag_1, lag_2, lag_3, lag_4 INTO NAME lag VALUE v), c AS (SELECT symbol, lag, count(ret) AS n, round(corr(v, ret), 9) AS c FROM l GROUP BY 1, 2)
SELECT symbol, lag, c FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(c) DESC, lag) AS k FROM c) WHERE k = 1""")
def _(spark, d):
    from tidemark.functions.frames import correlation

    b = views.hourly(spark, d).withColumn("ret", f.change("close"))
    x = b.select("symbol", "ret", *(f.lag("volume", k).alias(f"lag_{k}") for k in (1, 2, 3, 4)))
    c = x.unpivot(["symbol", "ret"], [f"lag_{k}" for k in (1, 2, 3, 4)], "lag", "v").groupBy("symbol", "lag").agg(F.round(correlation("v", "ret"), 9).alias("c"))
    w = Window.partitionBy("symbol").orderBy(F.desc(F.abs("c")), "lag")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


class _Apart:
    """Whether a moment is kept: the first, and each that is `gap` after the last that was kept."""

    def __init__(self, gap: timedelta):
        self.gap, self.last = gap, None

    def step(self, ts) -> tuple[bool]:
        keep = self.last is None or ts - self.last >= self.gap
        self.last = ts if keep else self.last
        return (keep,)


@query("tk06_refractory_peaks", f"""WITH RECURSIVE {HOURLY}, i AS (SELECT symbol, ts, volume, sum(CASE WHEN volume >= 60 THEN 0 ELSE 1 END) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS island FROM bars), p AS (SELECT symbol, arg_max(ts, (volume, ts)) AS ts, max(volume) AS volume FROM i WHERE volume >= 60 GROUP BY symbol, island),
k AS (SELECT *, row_number() OVER ({_S}) AS k FROM p), r AS (SELECT symbol, k, ts, volume, true AS kept, ts AS last FROM k WHERE k = 1 UNION ALL SELECT k.symbol, k.k, k.ts, k.volume, k.ts - r.last >= INTERVAL 6 HOUR, CASE WHEN k.ts - r.last >= INTERVAL 6 HOUR THEN k.ts ELSE r.last END FROM r JOIN k ON k.symbol = r.symbol AND k.k = r.k + 1) SELECT symbol, ts, volume FROM r WHERE kept""")
def _(spark, d):
    """The largest print of each burst, at most one in six hours."""
    h = views.hourly(spark, d).withColumn("island", f.island(F.col("volume") >= 60))
    peaks = h.where("volume >= 60").groupBy("symbol", "island").agg(F.max_by("ts", F.struct("volume", "ts")).alias("ts"), F.max("volume").alias("volume")).drop("island")
    kept = recursive.sequential(peaks, ["symbol"], ["ts"], ["ts"], lambda: _Apart(timedelta(hours=6)).step, "kept boolean")
    return kept.where("kept").select("symbol", "ts", "volume")


@query("wn17_decayed_peak", f"""WITH RECURSIVE {HOURLY}, n AS (SELECT symbol, ts, volume, row_number() OVER ({_S}) AS k FROM bars), m AS (SELECT symbol, ts, k, volume AS peak FROM n WHERE k = 1
UNION ALL SELECT n.symbol, n.ts, n.k, greatest(n.volume, 0.97 * m.peak) FROM m JOIN n ON n.symbol = m.symbol AND n.k = m.k + 1) SELECT symbol, ts, peak FROM m""")
def _(spark, d):
    """m_t = max(s_t, 0.97 m_(t-1)): 0.97^t times the running maximum of s / 0.97^t, in logarithms, over the whole history."""
    k, decay = F.row_number().over(f.ordered), F.lit(math.log(0.97))
    n = views.hourly(spark, d).withColumn("k", k).withColumn("lift", F.when(F.col("volume") > 0, F.log("volume") - F.col("k") * decay))
    return n.select("symbol", "ts", F.coalesce(F.exp(F.max("lift").over(f.so_far) + F.col("k") * decay), F.lit(0.0)).alias("peak"))


@query("wn22_gate_drift", f"""WITH {HOURLY}, x AS (SELECT symbol, ts, CASE WHEN taker_buy_ratio > 0.6 THEN 1.0 ELSE 0.0 END AS pass, volume FROM bars) SELECT symbol, ts, CASE WHEN count(*) OVER {_w(300)} >= 60 THEN avg(pass) OVER {_w(300)} END AS pass_rate, CASE WHEN count(*) OVER {_w(300)} >= 60 THEN quantile_cont(volume, 0.95) OVER {_w(300)} END AS tail FROM x""")
def _(spark, d):
    x = views.hourly(spark, d).select("symbol", "ts", F.when(F.col("taker_buy_ratio") > 0.6, 1.0).otherwise(0.0).alias("pass"), "volume")
    return x.select("symbol", "ts", f.mean("pass", 300, 60).alias("pass_rate"), f.quantile("volume", 300, 0.95, 60).alias("tail"))


@query("pf17_benchmarks", f"WITH {DAILY}, r AS (SELECT date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM daily), e AS (SELECT date, avg(ret) AS ret, count(ret) AS names FROM r WHERE ret IS NOT NULL GROUP BY date HAVING count(ret) >= 5) SELECT date, ret, names, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM e")
def _(spark, d):
    r = views.daily(spark, d).select("date", BY_DAY.change("close").alias("ret")).where("ret IS NOT NULL")
    e = r.groupBy("date").agg(F.avg("ret").alias("ret"), F.count("ret").alias("names")).where("names >= 5")
    w = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return e.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(w)))


@query("pf20_bad_trade_windows", f"WITH {TRADES}, x AS (SELECT side, trade_id, exit_time, CASE WHEN abs(pnl_r) < 0.1 THEN 1 ELSE 0 END AS bad FROM trades) SELECT side, trade_id, exit_time, bad, CAST(sum(bad) OVER (PARTITION BY side ORDER BY exit_time RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS bad_week FROM x")
def _(spark, d):
    x = views.trades(spark, d).select("side", "trade_id", "exit_time", F.when(F.abs("pnl_r") < 0.1, 1).otherwise(0).alias("bad"))
    w = Window.partitionBy("side").orderBy(F.datediff("exit_time", F.lit("1970-01-01").cast("date"))).rangeBetween(-7, 0)
    return x.withColumn("bad_week", F.sum("bad").over(w))


@query("pf29_pf23_allowed_and_size", f"""WITH {DAILY}, r AS (SELECT symbol, date, close / lag(close, 90) OVER (PARTITION BY symbol ORDER BY date) - 1 AS roc FROM daily) SELECT symbol, date, CASE WHEN roc >= 0.15 THEN 'bull' WHEN roc > -0.15 THEN 'not_bear' ELSE 'off' END AS regime, greatest(0, least(1, 0.5 + roc)) AS size FROM r WHERE roc IS NOT NULL""")
def _(spark, d):
    r = views.daily(spark, d).select("symbol", "date", BY_DAY.change("close", 90).alias("roc")).where("roc IS NOT NULL")
    return r.select("symbol", "date", F.when(F.col("roc") >= 0.15, "bull").when(F.col("roc") > -0.15, "not_bear").otherwise("off").alias("regime"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.col("roc"))).alias("size"))


@query("st13_tick_gaps", f"WITH {TICKS}, g AS (SELECT symbol, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS us FROM ticks) SELECT symbol, count(us) AS n, avg(us / 1e6) AS mean_gap, max(us / 1e6) AS longest_gap FROM g GROUP BY symbol")
def _(spark, d):
    t = Frames(("symbol",), ("ts", "seq"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = views.ticks(spark, d).select("symbol", ((us - F.lag(us).over(t.ordered)) / 1e6).alias("gap"))
    return g.groupBy("symbol").agg(F.count("gap").alias("n"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("longest_gap"))


@query("sk18_chop_scan", f"""WITH {HOURLY}, x AS (SELECT (high - low) / close AS feature, lead(close) OVER ({_S}) > close AS good, lead(close) OVER ({_S}) / close - 1 AS r FROM bars), s AS (SELECT *, min(feature) OVER () AS lo, max(feature) OVER () AS hi FROM x WHERE r IS NOT NULL), c AS (SELECT CAST(least(floor((feature - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS step, any_value(lo) AS lo, any_value(hi) AS hi, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b, sum(r) AS r FROM s GROUP BY 1)
SELECT step, lo + step * (hi - lo) / 20 AS threshold, CAST(sum(g) OVER w + sum(b) OVER w AS BIGINT) AS kept, round(sum(r) OVER w / (sum(g) OVER w + sum(b) OVER w), 9) + 0.0 AS mean_r FROM c WINDOW w AS (ORDER BY step DESC ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    x = views.hourly(spark, d).select(((F.col("high") - F.col("low")) / F.col("close")).alias("feature"), (f.lead("close") > F.col("close")).alias("good"), (f.lead("close") / F.col("close") - 1).alias("r")).where("r IS NOT NULL")
    return stats.threshold_scan(x, "feature", "good", "r", 20).select("step", "threshold", "kept", (F.round("mean_r", 9) + 0.0).alias("mean_r"))
