"""Loaders, exits and first touches, processors, entry rules, universes, accounts and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import bar_features, recursive
from tidemark.functions.frames import Frames, cross_rank
from tidemark.operators import bars, labels, processors, stats
from tidemark.operators.bars import BY_TIME as f
from tidemark.operators.panels import BY_DAY
from tidemark.plans.bar_features import RECURSIVE
from tidemark.plans.register import query
from tidemark.plans.windows import _S, _w
from tidemark.sources import store, views
from tidemark.sources.views import DAILY, HOURLY, SCAN, TICKS, TRADES
from tidemark.streaming.run import scratch

_D = "PARTITION BY symbol ORDER BY date"


# --- loaders and layers -------------------------------------------------------------------
@query("io04_io06_daily_bars", f"""WITH {DAILY}, v AS (SELECT symbol, date, close, CASE WHEN symbol % 2 = 0 THEN close * 0.9 END AS adjclose, 1 AS version FROM daily UNION ALL SELECT symbol, date, close + 1, NULL, 2 FROM daily WHERE day(date) = 3),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY version DESC) AS k FROM v WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND symbol <= 40), p AS (SELECT symbol, date, close, coalesce(adjclose, close) AS price FROM k WHERE k = 1)
SELECT *, price / lag(price) OVER ({_D}) - 1 AS ret FROM p""")
def _(spark, d):
    daily = views.daily(spark, d).select("symbol", "date", "close")
    versions = daily.select("*", F.when(F.col("symbol") % 2 == 0, F.col("close") * 0.9).alias("adjclose"), F.lit(1).alias("version")).unionByName(daily.where("day(date) = 3").select("symbol", "date", (F.col("close") + 1).alias("close"), F.lit(None).cast("double").alias("adjclose"), F.lit(2).alias("version")))
    rows = store.load_bars(versions, ["symbol", "date"], "date", "1996-01-01", "1997-06-30", "version").where("symbol <= 40")
    return rows.select("symbol", "date", "close", F.coalesce("adjclose", "close").alias("price")).withColumn("ret", BY_DAY.change("price"))


@query("io09_layer_without_a_month", f"WITH {HOURLY} SELECT symbol, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM bars WHERE NOT (symbol = 'click' AND strftime(ts, '%Y-%m') = '2024-01') GROUP BY 1, 2")
def _(spark, d):
    path = scratch(spark, "layer")
    store.write_layer(views.hourly(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).select("symbol", "ts", "close"), path)
    store.delete_month(spark, path, "click", "2024-01")
    return store.months_present(spark, path)


@query("io11_snapshots_to_bars", f"""WITH {TICKS}, s AS (SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, arg_max(price, (ts, seq)) AS price, arg_max(volume, (ts, seq)) AS volume, count(*) AS snapshots FROM ticks GROUP BY 1, 2)
SELECT * FROM s WHERE ts + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM ticks)""")
def _(spark, d):
    return bars.from_snapshots(views.ticks(spark, d), "15 minutes", ["price", "volume"])


# --- exits and labels -----------------------------------------------------------------------
_ATR = f"{RECURSIVE}, p AS (SELECT *, lead(open) OVER ({_S}) AS entry, list({{'high': high, 'low': low, 'close': close}}) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS path FROM seq)"


def _exits_sql(trail: str) -> str:
    return f"""{_ATR}, s AS (SELECT symbol, ts, entry, atr, path, list_transform(path, lambda x, i: {{'high': x.high, 'low': x.low, 'close': x.close, 'i': i, 'level': {trail}}}) AS steps FROM p WHERE entry IS NOT NULL AND len(path) = 12 AND atr > 0),
h AS (SELECT *, list_filter(steps, lambda x: x.low <= x.level OR x.high >= entry + 2 * atr)[1] AS hit, steps[12] AS final FROM s),
x AS (SELECT symbol, ts, CASE WHEN hit IS NULL THEN 12 ELSE hit.i END AS held, CASE WHEN hit IS NULL THEN 'time' WHEN hit.low <= hit.level THEN 'stop' ELSE 'target' END AS reason, CASE WHEN hit IS NULL THEN final.close WHEN hit.low <= hit.level THEN hit.level ELSE entry + 2 * atr END AS exit_price, entry, atr FROM h)"""


_PLAIN, _TRAIL = "entry - atr", "CASE WHEN i = 1 THEN entry - atr ELSE greatest(entry - atr, list_max(list_transform(path[1:i - 1], lambda q: q.high)) - 1.5 * atr) END"


_BOTH = f"""{RECURSIVE}, both_sides AS (SELECT symbol, ts, 1 AS side, open, high, low, close, atr FROM seq UNION ALL SELECT symbol, ts, -1, -open, -low, -high, -close, atr FROM seq),
p AS (SELECT *, lead(open) OVER w AS entry, list({{'high': high, 'low': low, 'close': close}}) OVER (PARTITION BY symbol, side ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS path FROM both_sides WINDOW w AS (PARTITION BY symbol, side ORDER BY ts)),
s AS (SELECT symbol, ts, side, entry, atr, list_transform(path, lambda x, i: {{'high': x.high, 'low': x.low, 'close': x.close, 'level': CASE WHEN i = 1 THEN entry - atr ELSE greatest(entry - atr, list_max(list_transform(path[1:i - 1], lambda q: q.high)) - 1.5 * atr) END}}) AS steps, entry IS NOT NULL AND len(path) = 12 AND atr > 0 AS known FROM p),
h AS (SELECT *, list_filter(steps, lambda x: x.low <= x.level OR x.high >= entry + 2 * atr)[1] AS hit FROM s),
r AS (SELECT symbol, ts, side, CASE WHEN known THEN (CASE WHEN hit IS NULL THEN steps[12].close WHEN hit.low <= hit.level THEN hit.level ELSE entry + 2 * atr END - entry) / atr END AS r FROM h),
b AS (SELECT symbol, ts, max(r) FILTER (side = 1) AS realized_r_long, max(r) FILTER (side = -1) AS realized_r_short FROM r GROUP BY 1, 2)"""


@query("lb18_realized_r_long_short", f"WITH RECURSIVE {_BOTH} SELECT *, CASE WHEN abs(realized_r_long - realized_r_short) >= 0.1 THEN realized_r_long - realized_r_short END AS label FROM b")
def _(spark, d):
    """Long less short under a trailing stop, a target of two and twelve bars; under 0.1 apart is no label."""
    return labels.realized_r(recursive.with_indicators(views.hourly(spark, d)), "atr", 12, 1.0, 2.0, 1.5, floor=0.1)


def _exits(spark, d, trail=None):
    rows = recursive.with_indicators(views.hourly(spark, d)).select("symbol", "ts", "open", "high", "low", "close", "atr")
    return labels.exits(rows, f, "atr", 12, 1.0, 2.0, trail).where("reason IS NOT NULL")


@query("lb03_exits", f"WITH RECURSIVE {_exits_sql(_PLAIN)} SELECT symbol, ts, CAST(held AS INTEGER) AS held, reason, exit_price, (exit_price - entry) / atr AS r FROM x")
def _(spark, d):
    return _exits(spark, d).select("symbol", "ts", "held", "reason", "exit_price", "r")


@query("lb03_trailing_exits", f"WITH RECURSIVE {_exits_sql(_TRAIL)} SELECT symbol, ts, CAST(held AS INTEGER) AS held, reason, exit_price, (exit_price - entry) / atr AS r FROM x")
def _(spark, d):
    return _exits(spark, d, 1.5).select("symbol", "ts", "held", "reason", "exit_price", "r")


@query("pf18_exit_mix", f"WITH RECURSIVE {_exits_sql(_TRAIL)} SELECT symbol, reason, count(*) AS n, avg((exit_price - entry) / atr) AS mean_r, avg(held) AS mean_held, count(*) / CAST(sum(count(*)) OVER (PARTITION BY symbol) AS DOUBLE) AS share FROM x GROUP BY symbol, reason")
def _(spark, d):
    g = _exits(spark, d, 1.5).groupBy("symbol", "reason").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.avg("held").alias("mean_held"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol")))


@query("sk11_exit_r_by_threshold", f"""WITH RECURSIVE {_exits_sql(_PLAIN)}, j AS (SELECT x.symbol, (exit_price - entry) / x.atr AS r, b.taker_buy_ratio AS v FROM x JOIN bars b USING (symbol, ts)), t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS n, avg(r) AS mean_r, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS won FROM j JOIN t ON v >= threshold GROUP BY threshold""")
def _(spark, d):
    """Exits once, then a row meets each of five thresholds that it passes."""
    rows = _exits(spark, d).select("symbol", "ts", "r").join(views.hourly(spark, d).select("symbol", "ts", "taker_buy_ratio"), ["symbol", "ts"])
    passed = rows.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, (0.3, 0.4, 0.5, 0.6, 0.7))), lambda t: F.col("taker_buy_ratio") >= t)))
    return passed.groupBy("threshold").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("won"))


_FWD = f"""{HOURLY}, q AS (SELECT *, close / lag(close) OVER ({_S}) - 1 AS ret FROM bars), w AS (SELECT *, CASE WHEN count(ret) OVER a = 8 THEN sqrt(avg(ret * ret) OVER a) * close * 1.5 END AS dist, lead(open) OVER ({_S}) AS entry, list({{'high': high, 'low': low}}) OVER a AS path FROM q WINDOW a AS ({_S} ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING))"""


@query("lb04_adaptive_risk_reward", f"""WITH {_FWD}, h AS (SELECT symbol, ts, dist, list_position(list_transform(path, lambda x: x.high >= entry + 2 * dist), true) AS tp, list_position(list_transform(path, lambda x: x.low <= entry - dist), true) AS sl FROM w WHERE entry IS NOT NULL AND len(path) = 8 AND dist > 0)
SELECT symbol, ts, dist, CASE WHEN tp IS NOT NULL AND (sl IS NULL OR tp < sl) THEN 1 ELSE 0 END AS rr_label FROM h""")
def _(spark, d):
    """The stop is one and a half times the volatility of the path itself: a label, never a feature."""
    rows = labels.forward_volatility(views.hourly(spark, d).withColumn("ret", f.change("close")), f, "ret", 8)
    rows = rows.withColumn("dist", F.col("fwd_vol") * F.col("close") * 1.5)
    return labels.risk_reward(rows, f, atr="dist", r=2.0, stop=1.0, horizon=8).where("rr_label IS NOT NULL").select("symbol", "ts", "dist", "rr_label")


@query("lb06_first_touch", f"""WITH RECURSIVE {_ATR}, e AS (SELECT symbol, ts, list_transform(path, lambda x: {{'up': (x.high - close) / atr, 'down': (close - x.low) / atr}}) AS e FROM p WHERE len(path) = 12 AND atr > 0),
t AS (SELECT symbol, ts, list_max(list_transform(e, lambda x: x.up)) AS up, list_max(list_transform(e, lambda x: x.down)) AS down, list_filter(e, lambda x: x.up >= 1 OR x.down >= 1)[1] AS hit FROM e)
SELECT symbol, ts, CASE WHEN CASE WHEN hit IS NULL THEN up >= down WHEN hit.up >= 1 AND hit.down >= 1 THEN hit.up >= hit.down ELSE hit.up >= 1 END THEN up ELSE -down END AS first_touch_mfe FROM t""")
def _(spark, d):
    rows = recursive.with_indicators(views.hourly(spark, d)).select("symbol", "ts", "high", "low", "close", "atr")
    return labels.first_touch(rows, f, "atr", 12).where("first_touch_mfe IS NOT NULL").select("symbol", "ts", "first_touch_mfe")


@query("lb21_binary", f"WITH {HOURLY} SELECT symbol, ts, CASE WHEN lead(close, 5) OVER ({_S}) / close - 1 > 0.02 THEN 1 ELSE 0 END AS label FROM bars QUALIFY lead(close, 5) OVER ({_S}) IS NOT NULL")
def _(spark, d):
    rows = views.hourly(spark, d).withColumn("ahead", f.lead("close", 5) / F.col("close") - 1)
    return rows.where("ahead IS NOT NULL").select("symbol", "ts", (F.col("ahead") > 0.02).cast("int").alias("label"))


# --- processors and contracts ---------------------------------------------------------------
@query("dq05_dq06_dq07_dq13_processors", f"""WITH {HOURLY}, x AS (SELECT symbol, ts, volume, CASE WHEN buy_qty = 0 THEN 'Infinity'::DOUBLE ELSE sell_qty / buy_qty END AS ratio FROM bars), y AS (SELECT symbol, ts, volume, CASE WHEN isinf(ratio) THEN 0 ELSE ratio END AS ratio FROM x),
m AS (SELECT *, avg(ratio) OVER s AS rm, stddev_pop(ratio) OVER s AS rs, avg(volume) OVER s AS vm, stddev_pop(volume) OVER s AS vs FROM y WINDOW s AS (PARTITION BY symbol)) SELECT symbol, ts, CAST(CAST(least(greatest(ratio, rm - 2 * (rs + 1e-8)), rm + 2 * (rs + 1e-8)) AS FLOAT) AS DOUBLE) AS ratio, least(greatest(volume, vm - 2 * (vs + 1e-8)), vm + 2 * (vs + 1e-8)) AS volume FROM m""")
def _(spark, d):
    rows = views.hourly(spark, d).select("symbol", "ts", "volume", F.when(F.col("buy_qty") == 0, float("inf")).otherwise(F.try_divide("sell_qty", "buy_qty")).alias("ratio"))
    steps = [processors.replaced_infinite(["ratio"]), processors.sanitized(["ratio", "volume"], ["symbol"], 2.0), processors.downcast(["ratio"])]
    return processors.chained(rows, steps).withColumn("ratio", F.col("ratio").cast("double")).select("symbol", "ts", "ratio", "volume")


@query("dq12_rm16_contract", f"WITH {HOURLY}, c(feature, method) AS (VALUES ('atr_ratio', 'ratio'), ('box_pos_60', 'bounded'), ('zz_high_value', 'price'), ('tbr_ma_5', 'bounded'), ('not_made', 'zscore')) SELECT feature, method, method = 'price' AS excluded, feature = 'not_made' AS missing, (SELECT count(*) FROM bars) AS n FROM c")
def _(spark, d):
    """Declared methods against the features that exist: price units are excluded, what is declared and not made is missing."""
    declared = spark.createDataFrame([("atr_ratio", "ratio"), ("box_pos_60", "bounded"), ("zz_high_value", "price"), ("tbr_ma_5", "bounded"), ("not_made", "zscore")], "feature string, method string")
    made = [n for group in bar_features.FEATURES.values() for n in group]
    n = views.hourly(spark, d).agg(F.count("*").alias("n"))
    return declared.crossJoin(F.broadcast(n)).select("feature", "method", (F.col("method") == "price").alias("excluded"), (~F.col("feature").isin(made)).alias("missing"), "n")


@query("dq15_dq16_dq17_missing_features", f"WITH {HOURLY} SELECT symbol, ts, close, CASE WHEN hour(ts) < 20 THEN close - open END AS body, CASE WHEN hour(ts) < 20 THEN abs(close - open) / nullif(high - low, 0) END AS body_share FROM bars")
def _(spark, d):
    """Only what is absent is made, needed inputs first; its rows are laid on the base's, which stay as they are."""
    from tidemark.functions import catalog

    base = views.hourly(spark, d).select("symbol", "ts", "close")
    known = {"body": catalog.Feature("body", "price", ("open", "close"), lambda: F.col("close") - F.col("open")), "body_share": catalog.Feature("body_share", "price", ("body", "high", "low"), lambda: F.try_divide(F.abs("body"), F.col("high") - F.col("low")))}
    made = catalog.with_features(views.hourly(spark, d).where("hour(ts) < 20"), ["body_share"], known).select("symbol", "ts", "body", "body_share")
    return processors.aligned(base, made, ["symbol", "ts"])


# --- rules -----------------------------------------------------------------------------------
_STATE = f"WITH RECURSIVE {RECURSIVE}"


@query("pr07_pr12_pr16_pr17_entry", f"""{_STATE}, a AS (SELECT *, lag(CASE WHEN len(v) = 100 THEN len(list_filter(v, lambda x: x <= atr)) / 100.0 END) OVER ({_S}) AS pct FROM (SELECT *, list(atr) FILTER (atr IS NOT NULL) OVER {_w(100)} AS v FROM seq)),
z AS (SELECT *, CASE WHEN count(volume) OVER {_w(50)} >= 50 THEN (volume - avg(volume) OVER {_w(50)}) / nullif(stddev_samp(volume) OVER {_w(50)}, 0) END AS vz, max(high) OVER {_w(60)} AS hi, min(low) OVER {_w(60)} AS lo, count(*) OVER {_w(60)} AS k FROM a),
b AS (SELECT symbol, ts, CASE WHEN vz > 1.5 AND pct > 0.5 THEN 2 WHEN pct > 0.7 THEN 1 ELSE 0 END AS regime, coalesce(taker_buy_ratio > 0.55 AND rsi < 70, false) AS long_a, coalesce(vz > 1, false) AS any_side, coalesce(taker_buy_ratio < 0.45 AND rsi > 30, false) AS short_a, coalesce(k = 60 AND (hi - lo) / ((hi + lo) / 2) <= 0.6 AND close BETWEEN lo + 0.1 * (hi - lo) AND hi - 0.1 * (hi - lo), false) AS in_box FROM z)
SELECT symbol, ts, regime, in_box, long_a OR any_side AS long_ok, short_a OR any_side AS short_ok, (long_a OR any_side) AND regime < 2 AND NOT in_box AS long_allowed, (short_a OR any_side) AND regime < 2 AND NOT in_box AS short_allowed FROM b""")
def _(spark, d):
    """Entry filters (conditions joined by AND, filters by OR, some for one side only), the volatility and leverage state, and the block inside a stable box."""
    from tidemark.operators import rules

    rows = recursive.with_indicators(views.hourly(spark, d)).select("symbol", "ts", "high", "low", "close", "volume", "taker_buy_ratio", "rsi", "atr")
    share = F.collect_list("atr").over(f.past(100))
    rows = rows.withColumn("pct0", F.when(F.size(share) == 100, F.size(F.filter(share, lambda x: x <= F.col("atr"))) / 100))
    hi, lo = F.max("high").over(f.past(60)), F.min("low").over(f.past(60))
    rows = rows.withColumns({"pct": f.lag("pct0"), "vz": f.zscore("volume", 50), "hi": hi, "lo": lo, "k": F.count("*").over(f.past(60))})
    regime = F.when((F.col("vz") > 1.5) & (F.col("pct") > 0.5), 2).when(F.col("pct") > 0.7, 1).otherwise(0)
    edge = 0.1 * (F.col("hi") - F.col("lo"))
    box = F.coalesce((F.col("k") == 60) & ((F.col("hi") - F.col("lo")) / ((F.col("hi") + F.col("lo")) / 2) <= 0.6) & F.col("close").between(F.col("lo") + edge, F.col("hi") - edge), F.lit(False))
    known = ["taker_buy_ratio", "rsi", "vz"]
    any_side = rules.predicate("vz > 1", known)
    rows = rows.withColumns({"regime": regime, "in_box": box, "long_ok": rules.predicate("taker_buy_ratio > 0.55 AND rsi < 70", known) | any_side, "short_ok": rules.predicate("taker_buy_ratio < 0.45 AND rsi > 30", known) | any_side})
    allowed = lambda side: F.col(side) & (F.col("regime") < 2) & ~F.col("in_box")
    return rows.select("symbol", "ts", "regime", "in_box", "long_ok", "short_ok", allowed("long_ok").alias("long_allowed"), allowed("short_ok").alias("short_allowed"))


@query("pr13_evidence", f"""WITH {HOURLY}, q AS (SELECT symbol, quantile_cont(volume, 0.8) AS v80, quantile_cont(taker_buy_ratio, 0.2) AS t20 FROM bars GROUP BY symbol) SELECT symbol, ts, volume >= v80 AS heavy, taker_buy_ratio <= t20 AS sold, 0.7 * CAST(volume >= v80 AS INTEGER) + 0.3 * CAST(taker_buy_ratio <= t20 AS INTEGER) AS score FROM bars JOIN q USING (symbol)""")
def _(spark, d):
    """Quantile-binned features as booleans and a weighted score; the quantiles are one row a symbol."""
    rows = views.hourly(spark, d)
    q = rows.groupBy("symbol").agg(F.percentile("volume", F.lit(0.8)).alias("v80"), F.percentile("taker_buy_ratio", F.lit(0.2)).alias("t20"))
    heavy, sold = F.col("volume") >= F.col("v80"), F.col("taker_buy_ratio") <= F.col("t20")
    return rows.join(q, "symbol").select("symbol", "ts", heavy.alias("heavy"), sold.alias("sold"), (0.7 * heavy.cast("int") + 0.3 * sold.cast("int")).alias("score"))


@query("pr20_changed_thresholds", f"""WITH {SCAN}, r(rule_id, op, value) AS (VALUES (1, '>=', 10.0), (2, '>=', 30.0), (3, '<', 20.0)), n AS (SELECT rule_id, op, CASE WHEN op = '>=' THEN greatest(least(value + 5, 32.5), 0) ELSE value END AS value FROM r)
SELECT n.rule_id, n.op, CAST(n.value AS DOUBLE) AS value, count(*) AS denied FROM n JOIN scan ON (op = '>=' AND feature >= value) OR (op = '<' AND feature < value) GROUP BY ALL""")
def _(spark, d):
    """Rules are rows: a changed threshold stays within its interval; then the rows that each rule denies are counted."""
    rules_ = spark.createDataFrame([(1, ">=", 10.0), (2, ">=", 30.0), (3, "<", 20.0)], "rule_id int, op string, value double")
    changed = rules_.withColumn("value", F.when(F.col("op") == ">=", F.greatest(F.least(F.col("value") + 5, F.lit(32.5)), F.lit(0.0))).otherwise(F.col("value")))
    counts = views.scan(spark, d).groupBy("feature").agg(F.count("*").alias("n"))  # one row a distinct value
    hit = F.when(F.col("op") == ">=", F.col("feature") >= F.col("value")).otherwise(F.col("feature") < F.col("value"))
    return counts.join(F.broadcast(changed), hit).groupBy("rule_id", "op", "value").agg(F.sum("n").alias("denied"))


# --- screens ---------------------------------------------------------------------------------
_LAGS = (0, 1, 2, 3)


@query("sk04_screen", f"""WITH {HOURLY}, x AS (SELECT symbol, {', '.join(f'lag(taker_buy_ratio, {k}) OVER ({_S}) AS a_{k}, lag(volume, {k}) OVER ({_S}) AS b_{k}' for k in _LAGS)}, lead(close) OVER ({_S}) / close - 1 AS y FROM bars),
u AS (SELECT symbol, y, unnest([{', '.join(f"{{'feature': '{n}', 'lag': {k}, 'x': {c}_{k}}}" for c, n in (('a', 'taker_buy_ratio'), ('b', 'volume')) for k in _LAGS)}], recursive := true) FROM x), c AS (SELECT symbol, feature, lag, count(*) AS n, round(corr(x, y), 9) AS ic FROM u WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, feature ORDER BY abs(ic) DESC, lag) AS k FROM c) SELECT symbol, feature, CAST(lag AS INTEGER) AS lag, n, ic, CAST(sign(ic) AS INTEGER) AS direction FROM k WHERE k = 1 AND abs(ic) >= 0.01 AND n >= 30""")
def _(spark, d):
    """The best lag of each feature, if its correlation is large enough, and the sign that its use must have."""
    rows = views.hourly(spark, d).withColumn("y", f.lead("close") / F.col("close") - 1)
    lagged = F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(k).alias("lag"), F.lag(n, k).over(f.ordered).alias("x")) for n in ("taker_buy_ratio", "volume") for k in _LAGS))
    long = rows.withColumn("l", lagged).select("symbol", "y", F.inline("l")).where("x IS NOT NULL AND y IS NOT NULL")
    c = long.groupBy("symbol", "feature", "lag").agg(F.count("*").alias("n"), F.round(stats.correlation("x", "y"), 9).alias("ic"))
    best = F.row_number().over(Window.partitionBy("symbol", "feature").orderBy(F.desc(F.abs("ic")), "lag"))
    return c.withColumn("k", best).where("k = 1 AND abs(ic) >= 0.01 AND n >= 30").select("symbol", "feature", "lag", "n", "ic", F.signum("ic").cast("int").alias("direction"))


@query("sk09_robustness", f"""WITH {SCAN}, h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date, k1, k2) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM scan),
m AS (SELECT symbol, any_value(n) AS n, CAST(k > n // 2 AS INTEGER) AS half, avg(CAST(feature >= 25 AS INTEGER)) AS p, coalesce(avg(CAST(feature >= 25 AS INTEGER)) FILTER (is_good), 0) AS g, coalesce(avg(CAST(feature >= 25 AS INTEGER)) FILTER (NOT is_good), 0) AS b FROM h WHERE n >= 50 GROUP BY symbol, half),
s AS (SELECT a.n, 1 / (1 + 5 * (abs(a.p - z.p) + 0.5 * (abs(a.g - z.g) + abs(a.b - z.b)))) AS score FROM m a JOIN m z ON a.symbol = z.symbol AND a.half = 0 AND z.half = 1),
e AS (SELECT t, avg(CAST(feature >= t AS INTEGER)) AS p, avg(CAST(feature >= t AS INTEGER)) FILTER (is_good) AS g, avg(CAST(feature >= t AS INTEGER)) FILTER (NOT is_good) AS b FROM scan, (SELECT unnest([24, 25, 26]) AS t) GROUP BY t),
c AS (SELECT avg(abs(x.p - o.p) + 0.5 * (abs(x.g - o.g) + abs(x.b - o.b))) / greatest(any_value(o.p), 0.1) AS change, any_value(o.b) AS b FROM e x JOIN e o ON o.t = 25 AND x.t <> 25)
SELECT CAST(1 / (1 + 10 * change) * CASE WHEN b < 0.05 THEN 0.7 ELSE 1 END AS DOUBLE) AS parameter_stability, CAST((SELECT sum(n * score) / sum(n) FROM s) AS DOUBLE) AS temporal_stability FROM c""")
def _(spark, d):
    return stats.robustness(views.scan(spark, d), "feature", "is_good", 25.0, 1.0, "symbol", ["date", "k1", "k2"])


@query("sk14_band_median", f"WITH {SCAN}, t AS (SELECT symbol, date_trunc('year', date) AS year, median(feature) AS m, count(*) AS n FROM scan GROUP BY 1, 2) SELECT symbol, CAST(year AS DATE) AS year, CASE WHEN n >= 20 THEN m END AS median, CASE WHEN n >= 20 THEN m BETWEEN 20 AND 30 END AS in_band FROM t")
def _(spark, d):
    t = views.scan(spark, d).groupBy("symbol", F.trunc("date", "year").alias("year")).agg(F.percentile("feature", F.lit(0.5)).alias("m"), F.count("*").alias("n"))
    m = F.when(F.col("n") >= 20, F.col("m"))
    return t.select("symbol", "year", m.alias("median"), m.between(20, 30).alias("in_band"))


# --- universes, accounts and evaluation -------------------------------------------------------
@query("rm01_universe", f"""WITH {DAILY}, q AS (SELECT symbol, date_trunc('quarter', date) AS quarter, max(date) AS last FROM daily GROUP BY 1, 2), l AS (SELECT symbol, min(date) AS listed, max(date) AS seen FROM daily GROUP BY 1), e AS (SELECT date_trunc('quarter', date) AS quarter, max(date) AS quarter_end FROM daily GROUP BY 1)
SELECT e.quarter_end, l.symbol, CAST(e.quarter_end - l.listed AS INTEGER) AS age FROM e JOIN q USING (quarter) JOIN l USING (symbol) JOIN supplier s ON s.s_suppkey = l.symbol WHERE l.listed <= e.quarter_end AND l.seen >= DATE '2000-01-01' AND s.s_nationkey < 20""")
def _(spark, d):
    """Names traded in a quarter, listed by its last trading day, not gone before a date, of some boards."""
    daily = views.daily(spark, d).select("symbol", "date").withColumn("quarter", F.trunc("date", "quarter"))
    lives = daily.groupBy("symbol").agg(F.min("date").alias("listed"), F.max("date").alias("seen")).where("seen >= date '2000-01-01'")
    ends = daily.groupBy("quarter").agg(F.max("date").alias("quarter_end"))
    boards = views.table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("symbol"))
    rows = daily.select("symbol", "quarter").distinct().join(ends, "quarter").join(lives, "symbol").join(boards, "symbol", "left_semi")
    return rows.where("listed <= quarter_end").select("quarter_end", "symbol", F.datediff("quarter_end", "listed").alias("age"))


@query("rm05_rm11_progress", f"""{_STATE}, p AS (SELECT symbol, ts, close, atr, zz_high, max(high) OVER {_w(12)} AS top, lag(close, 11) OVER ({_S}) AS entry, k FROM (SELECT *, row_number() OVER ({_S}) AS k FROM seq)), pr AS (SELECT symbol, ts, (0.4 * least(greatest((top - entry) / atr / 2, 0), 1) + 0.3 * least(greatest((close - entry) / atr, 0), 1) + 0.2 * 12 / 48.0 + 0.1 * CASE WHEN close > entry THEN 0.5 ELSE 0 END) / 1.0 AS progress, abs(close - zz_high) <= 1.5 * atr AS near_level FROM p WHERE entry IS NOT NULL AND atr > 0)
SELECT symbol, ts, progress, greatest(1 - progress, 0) AS remaining, near_level FROM pr""")
def _(spark, d):
    """How much of its path a position entered 12 bars ago has made: weighted parts for excursion, result, time and structure, and what is left."""
    rows = recursive.with_indicators(views.hourly(spark, d)).withColumns({"top": F.max("high").over(f.past(12)), "entry": f.lag("close", 11)}).where("entry IS NOT NULL AND atr > 0")
    part = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    made = 0.4 * part((F.col("top") - F.col("entry")) / F.col("atr") / 2) + 0.3 * part((F.col("close") - F.col("entry")) / F.col("atr")) + 0.2 * 12 / 48 + 0.1 * F.when(F.col("close") > F.col("entry"), 0.5).otherwise(0.0)
    rows = rows.withColumn("progress", made)
    return rows.select("symbol", "ts", "progress", F.greatest(1 - F.col("progress"), F.lit(0.0)).alias("remaining"), (F.abs(F.col("close") - F.col("zz_high")) <= 1.5 * F.col("atr")).alias("near_level"))


_EVAL = f"""{DAILY}, y AS (SELECT symbol, date, lead(close) OVER ({_D}) / close - 1 AS y, least(greatest(close / lag(close) OVER ({_D}) - 1, -1), 1) AS p FROM daily), s AS (SELECT symbol, date, p * y AS r FROM y WHERE p IS NOT NULL AND y IS NOT NULL),
e AS (SELECT *, exp(sum(ln(greatest(1 + r, 1e-9))) OVER ({_D} ROWS UNBOUNDED PRECEDING)) AS equity FROM s), m AS (SELECT *, equity / max(equity) OVER ({_D} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)"""


@query("rm06_rm08_rm15_evaluation", f"""WITH {_EVAL}, g AS (SELECT symbol, count(*) AS n, sum(r) AS total_return, CASE WHEN stddev_pop(r) > 1e-8 THEN avg(r) / stddev_pop(r) * sqrt(252) ELSE 0 END AS sharpe, min(dd) AS max_drawdown, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, coalesce(avg(r) FILTER (r > 0), 0) AS avg_win, coalesce(abs(avg(r) FILTER (r < 0)), 0) AS avg_loss, stddev_pop(r) * sqrt(252) AS volatility FROM m GROUP BY symbol)
SELECT *, CASE WHEN n < 252 THEN total_return * 252 / n ELSE total_return END AS annualized, CASE WHEN abs(max_drawdown) > 1e-8 THEN CASE WHEN n < 252 THEN total_return * 252 / n ELSE total_return END / abs(max_drawdown) ELSE 0 END AS calmar, CASE WHEN -max_drawdown <= 0.35 AND total_return >= -0.2 THEN 1 ELSE 0 END AS viable, CASE WHEN n >= 100 AND volatility < 5 THEN 'normal' ELSE 'degrade_to_notrade' END AS decision FROM g""")
def _(spark, d):
    y = views.daily(spark, d).select("symbol", "date", (BY_DAY.lead("close") / F.col("close") - 1).alias("y"), F.least(F.greatest(BY_DAY.change("close"), F.lit(-1.0)), F.lit(1.0)).alias("p"))
    s = y.where("p IS NOT NULL AND y IS NOT NULL").select("symbol", "date", (F.col("p") * F.col("y")).alias("r"))
    s = s.withColumn("equity", F.exp(F.sum(F.log(F.greatest(1 + F.col("r"), F.lit(1e-9)))).over(BY_DAY.so_far))).withColumn("dd", BY_DAY.drawdown("equity"))
    sd = F.stddev_pop("r")
    g = s.groupBy("symbol").agg(
        F.count("*").alias("n"), F.sum("r").alias("total_return"), F.when(sd > 1e-8, F.avg("r") / sd * 252**0.5).otherwise(0.0).alias("sharpe"), F.min("dd").alias("max_drawdown"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(F.col("r") > 0, F.col("r"))), F.lit(0.0)).alias("avg_win"), F.coalesce(F.abs(F.avg(F.when(F.col("r") < 0, F.col("r")))), F.lit(0.0)).alias("avg_loss"), (sd * 252**0.5).alias("volatility"))
    year = F.when(F.col("n") < 252, F.col("total_return") * 252 / F.col("n")).otherwise(F.col("total_return"))
    viable = (-F.col("max_drawdown") <= 0.35) & (F.col("total_return") >= -0.2)
    return g.select("*", year.alias("annualized"), F.when(F.abs("max_drawdown") > 1e-8, year / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"), viable.cast("int").alias("viable"), F.when((F.col("n") >= 100) & (F.col("volatility") < 5), "normal").otherwise("degrade_to_notrade").alias("decision"))


@query("rm09_group_statistics", f"""WITH {SCAN}, b AS (SELECT *, CAST(floor(feature / 10) AS BIGINT) AS bucket FROM scan) SELECT bucket, count(*) AS n, avg(r) AS mean, quantile_cont(r, 0.1) AS q10, median(r) AS q50, quantile_cont(r, 0.9) AS q90, avg(CAST(is_good AS INTEGER)) AS good FROM b GROUP BY bucket""")
def _(spark, d):
    b = views.scan(spark, d).withColumn("bucket", F.floor(F.col("feature") / 10))
    q = lambda x: F.percentile("r", F.lit(x))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"), F.avg(F.col("is_good").cast("int")).alias("good"))


@query("rm10_feature_pick", f"""WITH {DAILY}, x AS (SELECT symbol % 4 AS timeframe, unnest([{{'feature': 'volume', 'x': volume}}, {{'feature': 'amount', 'x': amount}}, {{'feature': 'range', 'x': high - low}}, {{'feature': 'close', 'x': close}}], recursive := true), lead(close) OVER ({_D}) / close - 1 AS y FROM daily),
c AS (SELECT timeframe, feature, round(corr(x, y), 9) AS ic FROM x WHERE y IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY timeframe ORDER BY abs(ic) DESC, feature) AS k FROM c WHERE abs(ic) >= 0.02) SELECT feature, count(*) AS timeframes, count(*) / 4.0 AS share, max(abs(ic)) AS best FROM k WHERE k <= 3 GROUP BY feature HAVING count(*) / 4.0 >= 0.5""")
def _(spark, d):
    """Of each timeframe the strongest features, and those that many timeframes share."""
    rows = views.daily(spark, d).withColumn("y", BY_DAY.lead("close") / F.col("close") - 1).where("y IS NOT NULL")
    some = F.array(*(F.struct(F.lit(n).alias("feature"), c.alias("x")) for n, c in (("volume", F.col("volume")), ("amount", F.col("amount")), ("range", F.col("high") - F.col("low")), ("close", F.col("close")))))
    c = rows.withColumn("s", some).select((F.col("symbol") % 4).alias("timeframe"), "y", F.inline("s")).groupBy("timeframe", "feature").agg(F.round(stats.correlation("x", "y"), 9).alias("ic")).where("abs(ic) >= 0.02")
    k = F.row_number().over(Window.partitionBy("timeframe").orderBy(F.desc(F.abs("ic")), "feature"))
    return c.withColumn("k", k).where("k <= 3").groupBy("feature").agg(F.count("*").alias("timeframes"), (F.count("*") / 4).alias("share"), F.max(F.abs("ic")).alias("best")).where("share >= 0.5")


@query("rm12_rm13_marked_account", f"""WITH {TRADES}, t AS (SELECT *, 100 + trade_id % 50 AS entry, 100 + trade_id % 37 AS exit_px FROM trades), p AS (SELECT trade_id, symbol, entry_time, CASE WHEN side = 'long' THEN 1 ELSE -1 END * (exit_px - entry) / CAST(entry AS DOUBLE) AS linear_pct, CASE WHEN side = 'long' THEN 1 ELSE -1 END * (exit_px - entry) / CAST(exit_px AS DOUBLE) AS inverse_pct,
CASE WHEN side = 'long' THEN 1 ELSE -1 END * 100 * (1.0 / entry - 1.0 / exit_px) * exit_px AS inverse_usd FROM t) SELECT symbol, entry_time AS day, sum(linear_pct) AS linear_pct, sum(inverse_pct) AS inverse_pct, sum(inverse_usd) AS inverse_usd, 10000 + sum(sum(inverse_usd)) OVER (PARTITION BY symbol ORDER BY entry_time) AS account FROM p GROUP BY symbol, entry_time""")
def _(spark, d):
    """Result of linear and inverse contracts in percent and in dollars, and the account that they leave."""
    t = views.trades(spark, d).select("symbol", "entry_time", F.when(F.col("side") == "long", 1).otherwise(-1).alias("s"), (100 + F.col("trade_id") % 50).cast("double").alias("entry"), (100 + F.col("trade_id") % 37).cast("double").alias("out"))
    move = F.col("s") * (F.col("out") - F.col("entry"))
    g = t.groupBy("symbol", F.col("entry_time").alias("day")).agg(F.sum(move / F.col("entry")).alias("linear_pct"), F.sum(move / F.col("out")).alias("inverse_pct"), F.sum(F.col("s") * 100 * (1 / F.col("entry") - 1 / F.col("out")) * F.col("out")).alias("inverse_usd"))
    return g.withColumn("account", 10000 + F.sum("inverse_usd").over(Frames(("symbol",), ("day",)).so_far))


@query("rm14_pools", f"""WITH {TRADES}, p AS (SELECT symbol, entry_time AS day, side, trade_id % 3 AS pool, count(*) AS n, sum(abs(pnl_r)) AS size FROM trades GROUP BY ALL) SELECT symbol, day, side, count(*) AS pools, sum(size) AS gross, count(*) > 1 AS conflict FROM p GROUP BY symbol, day, side""")
def _(spark, d):
    p = views.trades(spark, d).groupBy("symbol", F.col("entry_time").alias("day"), "side", (F.col("trade_id") % 3).alias("pool")).agg(F.sum(F.abs("pnl_r")).alias("size"))
    return p.groupBy("symbol", "day", "side").agg(F.count("*").alias("pools"), F.sum("size").alias("gross")).withColumn("conflict", F.col("pools") > 1)


@query("rm18_aliases", f"WITH {HOURLY} SELECT symbol, ts, coalesce(CASE WHEN buy_qty > 0 THEN sell_qty / buy_qty END, CASE WHEN taker_buy_ratio > 0.4 THEN taker_buy_ratio END, 0.5) AS chop FROM bars")
def _(spark, d):
    """The first finite one of several columns that mean the same."""
    rows = views.hourly(spark, d).withColumns({"a": F.when(F.col("buy_qty") > 0, F.try_divide("sell_qty", "buy_qty")).otherwise(float("inf")), "b": F.when(F.col("taker_buy_ratio") > 0.4, F.col("taker_buy_ratio")).otherwise(float("nan"))})
    return rows.select("symbol", "ts", F.coalesce(processors.finite("a"), processors.finite("b"), F.lit(0.5)).alias("chop"))


@query("ag04_orders_of_fills", """WITH m AS (SELECT l_suppkey, avg(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS mark FROM lineitem GROUP BY 1) SELECT l_orderkey AS order_id, count(*) AS fills, sum(CAST(l_tax AS DOUBLE) * CAST(l_quantity AS DOUBLE) * mark / 100) AS fee_usd, sum((CAST(l_discount AS DOUBLE) - 0.05) * CAST(l_quantity AS DOUBLE) * mark) AS pnl_usd, CAST(max(l_shipdate) AS DATE) AS last_fill FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_orderkey""")
def _(spark, d):
    """Partial fills of an order as one row, fees and results in dollars at the mark price of their symbol."""
    li = views.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", *(F.col(c).cast("double").alias(c[2:]) for c in ("l_extendedprice", "l_quantity", "l_tax", "l_discount")), F.to_date("l_shipdate").alias("day"))
    marks = li.groupBy("l_suppkey").agg(F.avg(F.col("extendedprice") / F.col("quantity")).alias("mark"))
    size = F.col("quantity") * F.col("mark")
    return li.join(marks, "l_suppkey").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("fills"), F.sum(F.col("tax") * size / 100).alias("fee_usd"), F.sum((F.col("discount") - 0.05) * size).alias("pnl_usd"), F.max("day").alias("last_fill"))


class _Debounced:
    """A state that changes only after it has lasted `least` rows."""

    def __init__(self, least: int):
        self.least, self.state, self.n = least, None, 0

    def step(self, raw: str) -> tuple[str]:
        self.n += 1
        if self.state is None:
            self.state, self.n = raw, 0
        elif raw != self.state and self.n >= self.least:
            self.state, self.n = raw, 0
        return (self.state,)


@query("st11_debounced_regime", f"""WITH RECURSIVE {HOURLY}, n AS (SELECT symbol, ts, row_number() OVER ({_S}) AS k, CASE WHEN taker_buy_ratio > 0.6 THEN 'bull' WHEN taker_buy_ratio < 0.4 THEN 'bear' ELSE 'flat' END AS raw FROM bars),
s AS (SELECT symbol, k, ts, raw, raw AS regime, 0 AS held FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.k, n.ts, n.raw, CASE WHEN n.raw <> s.regime AND s.held + 1 >= 3 THEN n.raw ELSE s.regime END, CASE WHEN n.raw <> s.regime AND s.held + 1 >= 3 THEN 0 ELSE s.held + 1 END FROM s JOIN n ON n.symbol = s.symbol AND n.k = s.k + 1) SELECT symbol, ts, raw, regime FROM s""")
def _(spark, d):
    t = F.col("taker_buy_ratio")
    rows = views.hourly(spark, d).select("symbol", "ts", F.when(t > 0.6, "bull").when(t < 0.4, "bear").otherwise("flat").alias("raw"))
    return recursive.sequential(rows, ["symbol"], ["ts"], ["raw"], lambda: _Debounced(3).step, "regime string")


@query("st10_walls", f"""WITH {TICKS}, l AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bar, side, CAST(floor(ln(price) / 0.05) AS BIGINT) AS bucket, sum(price * volume) AS notional FROM ticks GROUP BY ALL) SELECT symbol, bar, side, arg_max(bucket, (notional, -bucket)) AS bucket, max(notional) AS notional FROM l WHERE notional >= 1000 GROUP BY symbol, bar, side""")
def _(spark, d):
    """Levels of one side within five per cent as one wall; of each side and hour the largest, if large enough."""
    t = views.ticks(spark, d)
    levels = t.groupBy("symbol", F.window("ts", "1 hour")["start"].alias("bar"), "side", F.floor(F.log("price") / 0.05).alias("bucket")).agg(F.sum(F.col("price") * F.col("volume")).alias("notional")).where("notional >= 1000")
    return levels.groupBy("symbol", "bar", "side").agg(F.max_by("bucket", F.struct("notional", -F.col("bucket"))).alias("bucket"), F.max("notional").alias("notional"))
