"""Aggregations, rules, data quality, trade and account tables, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Frames
from tidemark.operators import quality, rules
from tidemark.operators.bars import BY_TIME
from tidemark.plans.register import query
from tidemark.sources import views
from tidemark.sources.views import DAILY, HOURLY, SCAN, TICKS, TRADES


@query("ag01_softmax_rank", f"""WITH {SCAN}, g AS (SELECT CAST(floor(feature / 10) AS BIGINT) AS bin, symbol % 5 AS kind, count(*) AS n, avg(CAST(is_good AS INTEGER)) AS rate FROM scan GROUP BY 1, 2)
SELECT bin, kind, n, rate, exp(rate / 0.1) / sum(exp(rate / 0.1)) OVER (PARTITION BY bin) AS weight FROM g""")
def _(spark, d):
    g = views.scan(spark, d).groupBy(F.floor(F.col("feature") / 10).alias("bin"), (F.col("symbol") % 5).alias("kind")).agg(F.count("*").alias("n"), F.avg(F.col("is_good").cast("int")).alias("rate"))
    e = F.exp(F.col("rate") / 0.1)
    return g.withColumn("weight", e / F.sum(e).over(Window.partitionBy("bin")))


@query("ag03_stage_pivot", """SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id""")
def _(spark, d):
    return views.table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.max("value")).where("click IS NOT NULL OR view IS NOT NULL OR purchase IS NOT NULL")


@query("ag06_funnel_rollup", """SELECT coalesce(event_type, 'ALL') AS stage, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, date_trunc('day', ts)), (date_trunc('day', ts)))""")
def _(spark, d):
    e = views.table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"))
    cube = e.cube("event_type", "day").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return cube.where("level IN (0, 2)").select(F.coalesce("event_type", F.lit("ALL")).alias("stage"), "day", "n")


@query("ag07_clusters", f"WITH {TICKS} SELECT symbol, time_bucket(INTERVAL '10 minutes', ts) AS bucket, count(*) AS n, sum(volume) AS volume, sum(price * volume) AS notional FROM ticks GROUP BY 1, 2 HAVING count(*) >= 3")
def _(spark, d):
    g = views.ticks(spark, d).groupBy("symbol", F.window("ts", "10 minutes")["start"].alias("bucket"))
    return g.agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("notional")).where("n >= 3")


@query("ag08_ag09_large_trades_imbalance", f"""WITH {TICKS}, q AS (SELECT symbol, quantile_cont(volume, 0.95) AS p95 FROM ticks GROUP BY 1) SELECT symbol, CAST(ts AS DATE) AS day, count(*) FILTER (volume >= p95) AS large, sum(volume) FILTER (volume >= p95) AS large_volume,
(sum(volume) FILTER (side = 1) - sum(volume) FILTER (side = -1)) / sum(volume) AS imbalance FROM ticks JOIN q USING (symbol) GROUP BY 1, 2""")
def _(spark, d):
    t = views.ticks(spark, d)
    q = t.groupBy("symbol").agg(F.percentile("volume", F.lit(0.95)).alias("p95"))
    large = F.col("volume") >= F.col("p95")
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("volume")))
    return t.join(q, "symbol").groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count(F.when(large, 1)).alias("large"), F.sum(F.when(large, F.col("volume"))).alias("large_volume"), ((side(1) - side(-1)) / F.sum("volume")).alias("imbalance"))


@query("ag10_failure_by_quantile", f"WITH {SCAN}, b AS (SELECT *, ntile(5) OVER (PARTITION BY symbol ORDER BY feature, k1, k2, date, r) AS bucket FROM scan) SELECT symbol, bucket, count(*) AS n, avg(CAST(NOT is_good AS INTEGER)) AS failure FROM b GROUP BY 1, 2")
def _(spark, d):
    rows = views.scan(spark, d).withColumn("bucket", F.ntile(5).over(Window.partitionBy("symbol").orderBy("feature", "k1", "k2", "date", "r")))
    return rows.groupBy("symbol", "bucket").agg(F.count("*").alias("n"), F.avg((~F.col("is_good")).cast("int")).alias("failure"))


@query("ag11_month_coverage", f"WITH {SCAN} SELECT symbol, count(DISTINCT date_trunc('month', date)) FILTER (feature >= 45) AS months_with_signal, count(DISTINCT date_trunc('month', date)) AS months FROM scan GROUP BY symbol")
def _(spark, d):
    m = F.trunc("date", "month")
    return views.scan(spark, d).groupBy("symbol").agg(F.countDistinct(F.when(F.col("feature") >= 45, m)).alias("months_with_signal"), F.countDistinct(m).alias("months"))


@query("ag12_tk02_winner_share", f"""WITH {TRADES}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pnl_r DESC, trade_id) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM trades)
SELECT symbol, sum(CASE WHEN k <= ceil(n * 0.1) AND pnl_r > 0 THEN pnl_r ELSE 0 END) / sum(CASE WHEN pnl_r > 0 THEN pnl_r ELSE 0 END) AS top_share, avg(pnl_r) FILTER (k > 3) AS mean_without_top3 FROM k GROUP BY symbol""")
def _(spark, d):
    w = Window.partitionBy("symbol")
    k = views.trades(spark, d).withColumns({"k": F.row_number().over(w.orderBy(F.desc("pnl_r"), "trade_id")), "n": F.count("*").over(w)})
    won = F.when(F.col("pnl_r") > 0, F.col("pnl_r")).otherwise(0)
    return k.groupBy("symbol").agg((F.sum(F.when(F.col("k") <= F.ceil(F.col("n") * 0.1), won).otherwise(0)) / F.sum(won)).alias("top_share"), F.avg(F.when(F.col("k") > 3, F.col("pnl_r"))).alias("mean_without_top3"))


@query("ag13_month_matrix", f"WITH {TRADES} SELECT CAST(date_trunc('month', exit_time) AS DATE) AS month, " + ", ".join(f"sum(pnl_r) FILTER (isodow(exit_time) = {k}) AS d{k}" for k in range(1, 8)) + " FROM trades GROUP BY 1")
def _(spark, d):
    t = views.trades(spark, d).select(F.trunc("exit_time", "month").alias("month"), (F.weekday("exit_time") + 1).alias("k"), "pnl_r")
    return t.groupBy("month").pivot("k", list(range(1, 8))).sum("pnl_r").toDF("month", *(f"d{k}" for k in range(1, 8)))


@query("ag14_sc14_entropy", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * log2(p)), 9) + 0.0 AS entropy, max(p) AS main_share FROM p GROUP BY 1")
def _(spark, d):
    c = views.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return p.groupBy("user_id").agg((F.round(-F.sum(F.col("p") * F.log2("p")), 9) + 0.0).alias("entropy"), F.max("p").alias("main_share"))


@query("ag15_histogram", f"WITH {SCAN} SELECT symbol, CAST(floor(feature / 5) AS BIGINT) AS bin, count(*) AS n FROM scan GROUP BY 1, 2")
def _(spark, d):
    return views.scan(spark, d).groupBy("symbol", F.floor(F.col("feature") / 5).alias("bin")).agg(F.count("*").alias("n"))


@query("ag16_value_profile", f"""WITH {TICKS}, v AS (SELECT symbol, CAST(ts AS DATE) AS day, CAST(floor(price / 5) AS BIGINT) AS bin, sum(volume) AS volume FROM ticks GROUP BY 1, 2, 3),
k AS (SELECT *, sum(volume) OVER (PARTITION BY symbol, day ORDER BY volume DESC, bin ROWS UNBOUNDED PRECEDING) - volume AS before, sum(volume) OVER (PARTITION BY symbol, day) AS total FROM v)
SELECT symbol, day, arg_min(bin, (-volume, bin)) * 5 + 2.5 AS poc, min(bin) FILTER (before < 0.7 * total) * 5 AS value_low, (max(bin) FILTER (before < 0.7 * total) + 1) * 5 AS value_high, any_value(total) AS total FROM k GROUP BY 1, 2""")
def _(spark, d):
    v = views.ticks(spark, d).groupBy("symbol", F.to_date("ts").alias("day"), F.floor(F.col("price") / 5).alias("bin")).agg(F.sum("volume").alias("volume"))
    w = Window.partitionBy("symbol", "day")
    run = w.orderBy(F.desc("volume"), "bin").rowsBetween(Window.unboundedPreceding, 0)
    k = v.withColumns({"before": F.sum("volume").over(run) - F.col("volume"), "total": F.sum("volume").over(w)})
    inside = F.when(F.col("before") < 0.7 * F.col("total"), F.col("bin"))
    poc = F.min_by("bin", F.struct((-F.col("volume")).alias("minus"), "bin"))
    return k.groupBy("symbol", "day").agg((poc * 5 + 2.5).alias("poc"), (F.min(inside) * 5).alias("value_low"), ((F.max(inside) + 1) * 5).alias("value_high"), F.first("total").alias("total"))


@query("tk01_tk04_top_per_day", f"WITH {TRADES} SELECT exit_time, trade_id, pnl_r FROM (SELECT *, row_number() OVER (PARTITION BY exit_time ORDER BY abs(pnl_r) DESC, trade_id) AS k FROM trades) WHERE k <= 2")
def _(spark, d):
    w = Window.partitionBy("exit_time").orderBy(F.desc(F.abs("pnl_r")), "trade_id")
    return views.trades(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 2").select("exit_time", "trade_id", "pnl_r")


_RULES = (
    {"phase": "guardrail", "priority": 2, "tag": "thin", "when": {"feature": "trade_count", "op": "<=", "value": 1}},
    {"phase": "hard_gate", "priority": 1, "tag": "one_sided", "when": {"any_of": [{"feature": "taker_buy_ratio", "op": ">=", "value": 0.95}, {"feature": "taker_buy_ratio", "op": "<=", "value": 0.05}]}},
    {"phase": "system_safety", "priority": 1, "tag": "wide", "when": {"all_of": [{"feature": "range", "op": ">", "value": 60}, {"feature": "trade_count", "op": ">=", "value": 3}]}},
    {"phase": "system_safety", "priority": 0, "tag": "never", "enabled": False, "when": {"feature": "range", "op": ">=", "value": 0}},
)


@query("pr04_pr05_pr06_gate_rules", f"""WITH {HOURLY} SELECT symbol, ts, CASE WHEN high - low > 60 AND trade_count >= 3 THEN 'wide' WHEN taker_buy_ratio >= 0.95 OR taker_buy_ratio <= 0.05 THEN 'one_sided' WHEN trade_count <= 1 THEN 'thin' END AS deny_tag FROM bars""")
def _(spark, d):
    rows = views.hourly(spark, d).withColumn("range", F.col("high") - F.col("low"))
    return rows.select("symbol", "ts", rules.deny_tag(_RULES).alias("deny_tag"))


@query("pr01_pr02_pr03_predicates", f"WITH {HOURLY} SELECT symbol, ts FROM bars WHERE abs(close) >= 120 AND trade_count > 2 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'")
def _(spark, d):
    window = (F.col("ts") >= F.lit("2024-01-03").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    rows = views.hourly(spark, d)
    return rows.where(rules.all_of([rules.predicate("abs(close) >= 120 AND trade_count > 2", rows.columns), window])).select("symbol", "ts")


@query("pr09_pr10_pr11_pr18_directions", f"""WITH {HOURLY}, x AS (SELECT symbol, ts, close - open AS move, taker_buy_ratio - 0.5 AS flow, taker_buy_ratio AS tbr FROM bars)
SELECT symbol, ts, coalesce(nullif(sign(move), 0), nullif(sign(flow), 0), 0.0) AS first_vote, CASE WHEN nullif(sign(move), 0) IS NULL AND nullif(sign(flow), 0) IS NULL THEN 0.0 WHEN coalesce(nullif(sign(move), 0), sign(flow)) = coalesce(nullif(sign(flow), 0), sign(move)) THEN coalesce(nullif(sign(move), 0), sign(flow)) ELSE 0.0 END AS consensus,
CASE WHEN least(move, flow) > 0.1 THEN 1 WHEN greatest(move, flow) < -0.1 THEN -1 ELSE 0 END AS agree, CASE WHEN abs(move) > 5 AND abs(move) < 40 THEN CAST(sign(move) AS INTEGER) ELSE 0 END AS band, CASE WHEN tbr >= 0.8 AND abs(move) >= 1 THEN 1 WHEN tbr <= 0.2 AND abs(move) >= 1 THEN -1 ELSE 0 END AS signal FROM x""")
def _(spark, d):
    x = views.hourly(spark, d).select("symbol", "ts", (F.col("close") - F.col("open")).alias("move"), (F.col("taker_buy_ratio") - 0.5).alias("flow"), F.col("taker_buy_ratio").alias("tbr")).withColumn("size", F.abs("move"))
    votes = [("move", "sign", 0.0), ("flow", "sign", 0.0)]
    return x.select("symbol", "ts", rules.vote(votes).alias("first_vote"), rules.vote(votes, consensus=True).alias("consensus"), rules.agree_outside("move", "flow", 0.1).alias("agree"), rules.in_band("move", 5, 40).alias("band"), rules.signals("tbr", "size", 0.2, 0.8, 1.0).alias("signal"))


@query("pr19_size_ladder", f"WITH {TRADES} SELECT trade_id, CASE WHEN pnl_r >= 1 THEN 1.0 WHEN pnl_r >= 0 THEN 0.6 WHEN pnl_r >= -1 THEN 0.3 ELSE 0.0 END AS size FROM trades")
def _(spark, d):
    return views.trades(spark, d).select("trade_id", rules.ladder("pnl_r", [(1, 1.0), (0, 0.6), (-1, 0.3)], 0.0).alias("size"))


@query("dq01_normalized", f"""WITH {SCAN} SELECT k1, k2, symbol, date, CASE WHEN stddev_pop(feature) OVER w > 0 THEN least(greatest((feature - avg(feature) OVER w) / stddev_pop(feature) OVER w, -3), 3) ELSE 0 END AS feature_norm FROM scan WINDOW w AS (PARTITION BY symbol)""")
def _(spark, d):
    return quality.normalized(views.scan(spark, d), ["feature"], ["symbol"]).select("k1", "k2", "symbol", "date", "feature_norm")


@query("dq02_fit_and_apply", f"""WITH {SCAN}, s AS (SELECT symbol, avg(feature) AS m, stddev_samp(feature) AS sd FROM scan WHERE date < DATE '1998-01-01' GROUP BY symbol) SELECT k1, k2, scan.symbol, date, CASE WHEN sd > 0 THEN (feature - m) / sd END AS feature_std FROM scan LEFT JOIN s USING (symbol)""")
def _(spark, d):
    rows = views.scan(spark, d)
    fitted = quality.statistics(rows.where("date < date '1998-01-01'"), ["feature", "r"], ["symbol"])
    return quality.applied(rows, fitted, ["feature", "r"], ["symbol"]).select("k1", "k2", "symbol", "date", "feature_std")


@query("dq03_dq04_fill_and_clip", f"""WITH {HOURLY}, n AS (SELECT symbol, ts, CASE WHEN trade_count > 1 THEN close END AS x FROM bars), m AS (SELECT symbol, ts, coalesce(x, median(x) OVER (PARTITION BY symbol)) AS x FROM n)
SELECT symbol, ts, least(greatest(x, quantile_cont(x, 0.25) OVER w - 1.5 * (quantile_cont(x, 0.75) OVER w - quantile_cont(x, 0.25) OVER w)), quantile_cont(x, 0.75) OVER w + 1.5 * (quantile_cont(x, 0.75) OVER w - quantile_cont(x, 0.25) OVER w)) AS x FROM m WINDOW w AS (PARTITION BY symbol)""")
def _(spark, d):
    n = views.hourly(spark, d).select("symbol", "ts", F.when(F.col("trade_count") > 1, F.col("close")).alias("x"))
    return quality.chained(n, lambda df: quality.filled(df, "x", BY_TIME, "median"), lambda df: quality.clipped(df, "x", ["symbol"], "iqr", 1.5))


@query("dq08_dq10_report", f"""WITH {HOURLY}, x AS (SELECT CASE WHEN trade_count > 1 THEN taker_buy_ratio END AS ratio, volume / nullif(buy_qty, 0) AS share, 1.0 AS one FROM bars), s AS (SELECT avg(ratio) AS mr, stddev_samp(ratio) AS sr, avg(share) AS ms, stddev_samp(share) AS ss FROM x),
r AS (SELECT 'ratio' AS "column", 'null' AS issue, count(*) FILTER (ratio IS NULL) AS "count", count(*) AS n FROM x UNION ALL SELECT 'share', 'null', count(*) FILTER (share IS NULL), count(*) FROM x UNION ALL SELECT 'share', 'outlier', count(*) FILTER (abs(share - ms) > 5 * ss), count(*) FROM x, s
UNION ALL SELECT 'ratio', 'outlier', count(*) FILTER (abs(ratio - mr) > 5 * sr), count(*) FROM x, s UNION ALL SELECT 'one', 'constant', count(*), count(*) FROM x) SELECT "column", issue, "count", "count" / n AS share, "count" / n > 0.5 AS high FROM r WHERE "count" > 0""")
def _(spark, d):
    b = views.hourly(spark, d)
    x = b.select(F.when(F.col("trade_count") > 1, F.col("taker_buy_ratio")).alias("ratio"), (F.col("volume") / F.nullif(F.col("buy_qty"), F.lit(0.0))).alias("share"), F.lit(1.0).alias("one"))
    return quality.report(x, ["ratio", "share", "one"])


@query("dq09_leakage", f"""WITH {HOURLY}, r AS (SELECT symbol, ts, volume, taker_buy_ratio, close / lag(close) OVER s - 1 AS ret FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)), x AS (SELECT volume, taker_buy_ratio, lead(ret) OVER s AS f, lag(ret) OVER s AS p FROM r WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
l AS (UNPIVOT x ON volume, taker_buy_ratio INTO NAME "column" VALUE v), g AS (SELECT "column", corr(v, f) AS future_corr, corr(v, p) AS past_corr FROM l GROUP BY 1) SELECT *, abs(future_corr) > 0.5 OR abs(future_corr) > abs(past_corr) + 0.3 AS suspect FROM g""")
def _(spark, d):
    rows = views.hourly(spark, d).withColumn("ret", BY_TIME.change("close"))
    return quality.leakage(rows, ["volume", "taker_buy_ratio"], BY_TIME, "ret")


@query("dq11_categories", "SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code, count(*) AS \"count\" FROM events GROUP BY event_type")
def _(spark, d):
    return quality.categories(views.table(spark, d, "events"), "event_type")


@query("pf15_pf21_period_limits", f"""WITH {TRADES}, w AS (SELECT side, CAST(date_trunc('week', exit_time) AS DATE) AS week, exit_time, trade_id, sum(pnl_r) OVER (PARTITION BY side, date_trunc('week', exit_time) ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS run FROM trades)
SELECT side, week, min(run) AS worst, arg_max(run, (exit_time, trade_id)) AS total, min(run) < -5 AS stopped FROM w GROUP BY 1, 2""")
def _(spark, d):
    week = F.trunc("exit_time", "week")
    t = views.trades(spark, d).withColumn("week", week)
    t = t.withColumn("run", F.sum("pnl_r").over(Window.partitionBy("side", "week").orderBy("exit_time", "trade_id").rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("side", "week").agg(F.min("run").alias("worst"), F.max_by("run", F.struct("exit_time", "trade_id")).alias("total"), (F.min("run") < -5).alias("stopped"))


@query("pf16_open_exposure", f"""WITH {TRADES}, dl AS (SELECT side, entry_time AS day, 1 AS delta FROM trades UNION ALL SELECT side, exit_time, -1 FROM trades), g AS (SELECT side, day, sum(delta) AS delta FROM dl GROUP BY 1, 2) SELECT side, day, CAST(sum(delta) OVER (PARTITION BY side ORDER BY day) AS BIGINT) AS open_trades FROM g""")
def _(spark, d):
    t = views.trades(spark, d)
    deltas = t.select("side", F.col("entry_time").alias("day"), F.lit(1).alias("delta")).union(t.select("side", "exit_time", F.lit(-1)))
    f = Frames(("side",), ("day",))
    return deltas.groupBy("side", "day").agg(F.sum("delta").alias("delta")).select("side", "day", F.sum("delta").over(f.so_far).alias("open_trades"))


@query("pf19_rm04_contract_pnl", f"""WITH {TRADES}, x AS (SELECT trade_id, side, 100 + abs(pnl_r) * 10 AS entry, 100 + pnl_r * 12 AS exit_price, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS s FROM trades) SELECT trade_id, least(1000 / (0.02 * entry), 50000 / entry) AS quantity,
s * (exit_price - entry) * least(1000 / (0.02 * entry), 50000 / entry) AS linear_pnl, CASE WHEN exit_price > 0 THEN s * (1 / entry - 1 / exit_price) * 1000 END AS inverse_pnl FROM x""")
def _(spark, d):
    s = F.when(F.col("side") == "long", 1).otherwise(-1)
    x = views.trades(spark, d).select("trade_id", s.alias("s"), (100 + F.abs("pnl_r") * 10).alias("entry"), (100 + F.col("pnl_r") * 12).alias("exit_price"))
    quantity = F.least(1000 / (0.02 * F.col("entry")), 50000 / F.col("entry"))
    return x.select("trade_id", quantity.alias("quantity"), (F.col("s") * (F.col("exit_price") - F.col("entry")) * quantity).alias("linear_pnl"), F.when(F.col("exit_price") > 0, F.col("s") * (1 / F.col("entry") - 1 / F.col("exit_price")) * 1000).alias("inverse_pnl"))


@query("rm02_rm03_edge_and_best", f"""WITH {TRADES}, e AS (SELECT symbol, avg(pnl_r) AS edge FROM trades WHERE exit_time > DATE '2000-01-01' - 720 AND exit_time <= DATE '2000-01-01' GROUP BY 1), c AS (SELECT t.exit_time, t.trade_id, t.symbol, abs(pnl_r) * edge AS merit FROM trades t JOIN e USING (symbol) WHERE exit_time > DATE '2000-01-01')
SELECT exit_time, trade_id, symbol, merit FROM (SELECT *, row_number() OVER (PARTITION BY exit_time ORDER BY merit DESC, trade_id) AS k FROM c) WHERE k = 1""")
def _(spark, d):
    t = views.trades(spark, d)
    edge = t.where("exit_time > date_sub(date '2000-01-01', 720) AND exit_time <= date '2000-01-01'").groupBy("symbol").agg(F.avg("pnl_r").alias("edge"))
    c = t.where("exit_time > date '2000-01-01'").join(edge, "symbol").select("exit_time", "trade_id", "symbol", (F.abs("pnl_r") * F.col("edge")).alias("merit"))
    w = Window.partitionBy("exit_time").orderBy(F.desc("merit"), "trade_id")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


@query("rm07_bucket_returns", f"""WITH {DAILY}, x AS (SELECT symbol, date, amount, lead(close) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS fwd FROM daily), b AS (SELECT *, ntile(5) OVER (PARTITION BY symbol ORDER BY amount, date) AS bucket FROM x WHERE fwd IS NOT NULL)
SELECT symbol, bucket, count(*) AS n, avg(fwd) AS mean_fwd, median(fwd) AS median_fwd FROM b GROUP BY 1, 2""")
def _(spark, d):
    f = Frames(("symbol",), ("date",))
    x = views.daily(spark, d).select("symbol", "date", "amount", (f.lead("close") / F.col("close") - 1).alias("fwd")).where("fwd IS NOT NULL")
    b = x.withColumn("bucket", F.ntile(5).over(Window.partitionBy("symbol").orderBy("amount", "date")))
    return b.groupBy("symbol", "bucket").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd"), F.percentile("fwd", F.lit(0.5)).alias("median_fwd"))


@query("sc01_to_sc13_scalars", """SELECT event_id, TRY_CAST(props AS DOUBLE) AS bad_number, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(sign(value - 50) AS DOUBLE) AS s, ln(1 + value) AS l, least(greatest(value, 10), 90) AS clipped, 1 / (1 + exp(-(value - 50) / 10)) AS sigmoid,
CAST(strftime(ts, '%G') AS INTEGER) * 100 + CAST(strftime(ts, '%V') AS INTEGER) AS iso_week, lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, date_trunc('week', ts) AS week, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, md5(event_type || ':' || CAST(event_id AS VARCHAR)) AS name, upper(event_type) LIKE '%ST%' AS has_st FROM events""")
def _(spark, d):
    v = F.col("value")
    return views.table(spark, d, "events").select(
        "event_id", F.expr("try_cast(props AS double)").alias("bad_number"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.signum(v - 50).alias("s"), F.log1p(v).alias("l"), F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0)).alias("clipped"),
        (1 / (1 + F.exp(-(v - 50) / 10))).alias("sigmoid"), F.expr("extract(yearofweek FROM ts) * 100 + weekofyear(ts)").alias("iso_week"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"), F.date_trunc("week", "ts").alias("week"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.md5(F.concat_ws(":", "event_type", F.col("event_id").cast("string"))).alias("name"), F.upper("event_type").like("%ST%").alias("has_st"))
