"""Labels and statistics of features against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels, stats
from tidemark.operators.bars import BY_TIME as f
from tidemark.plans.register import query
from tidemark.sources import views
from tidemark.sources.views import DAILY, HOURLY, SCAN, TRADES

_ATR = """tr AS (SELECT *, row_number() OVER s AS k, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS true_range FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
a AS (SELECT *, CASE WHEN count(true_range) OVER w >= 14 THEN avg(true_range) OVER w END AS atr FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""


def with_atr(bars):
    """A plain 14-bar mean of the true range, as a causal yardstick for labels."""
    before = f.lag("close")
    rows = bars.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return rows.withColumn("atr", f.mean("true_range", 14))


def _first(alias: str, cond: str) -> str:
    return f"list_min(list_filter(list_transform(path, lambda x, i: CASE WHEN {cond} THEN i END), lambda p: p IS NOT NULL)) AS {alias}"


_PATH = "p AS (SELECT symbol, ts, close, high, low, atr, lead(open) OVER (PARTITION BY symbol ORDER BY ts) AS entry, list({{'high': high, 'low': low}}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS path FROM a)"


@query("lb01_lb02_risk_reward", f"""WITH {HOURLY}, {_ATR}, {_PATH.format(h=24)}, h AS (SELECT *, {_first('tp', "x.high >= entry + 2 * atr")}, {_first('sl', "x.low <= entry - 1 * atr")}, entry IS NOT NULL AND len(path) = 24 AND atr > 0 AS known FROM p)
SELECT symbol, ts, CASE WHEN known THEN tp END AS tp_bar, CASE WHEN known THEN sl END AS sl_bar, CASE WHEN known THEN CASE WHEN tp IS NOT NULL AND (sl IS NULL OR tp < sl) THEN 1 ELSE 0 END END AS rr_label,
CASE WHEN known THEN (list_max(list_transform(path, lambda x: x.high)) - entry) / atr END AS mfe, CASE WHEN known THEN (entry - list_min(list_transform(path, lambda x: x.low))) / atr END AS mae FROM h""")
def _(spark, d):
    return labels.risk_reward(with_atr(views.hourly(spark, d)), f).select("symbol", "ts", "tp_bar", "sl_bar", "rr_label", "mfe", "mae")


@query("lb17_level_reaction", f"""WITH {HOURLY}, {_ATR}, {_PATH.format(h=24)}, s AS (SELECT symbol, ts, close, atr, max(high) OVER w AS top, min(low) OVER w AS bottom, max(high) OVER n AS hi, min(low) OVER n AS lo, count(high) OVER n AS ahead FROM a
WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), n AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
g AS (SELECT *, CASE WHEN close <= bottom + atr THEN 1 WHEN close >= top - atr THEN -1 ELSE 0 END AS signal, CASE WHEN close <= bottom + atr THEN bottom ELSE top END AS level FROM s),
q AS (SELECT *, CASE WHEN signal <> 0 AND level IS NOT NULL AND atr > 0 AND ahead = 5 THEN CASE WHEN signal > 0 AND (lo < level - 5e-1 * atr OR hi > level + 2 * atr) OR signal < 0 AND (hi > level + 5e-1 * atr OR lo < level - 2 * atr) THEN 'breakout' ELSE 'reversal' END END AS reaction FROM g),
h AS (SELECT *, {_first('tp', "x.high >= entry + 2 * atr")}, {_first('sl', "x.low <= entry - 1 * atr")}, entry IS NOT NULL AND len(path) = 24 AND atr > 0 AS known FROM p), r AS (SELECT symbol, ts, CASE WHEN known THEN CASE WHEN tp IS NOT NULL AND (sl IS NULL OR tp < sl) THEN 1 ELSE 0 END END AS rr_label FROM h)
SELECT symbol, ts, signal, level, reaction, CASE WHEN reaction = 'reversal' THEN rr_label END AS rr_label_reversal, CASE WHEN reaction = 'breakout' THEN rr_label END AS rr_label_breakout FROM q JOIN r USING (symbol, ts)""")
def _(spark, d):
    """Signals near the swing of the last 20 bars, what the next bars make of its level, and the risk-reward label by that."""
    rows = with_atr(views.hourly(spark, d))
    w = f.before(20)
    rows = rows.withColumns({"top": F.max("high").over(w), "bottom": F.min("low").over(w)})
    low, high = F.col("close") <= F.col("bottom") + F.col("atr"), F.col("close") >= F.col("top") - F.col("atr")
    rows = rows.withColumns({"signal": F.when(low, 1).when(high, -1).otherwise(0), "level": F.when(low, F.col("bottom")).otherwise(F.col("top"))})
    found = labels.by_reaction(labels.level_reaction(labels.risk_reward(rows, f), f, "signal", "level", "atr"), "rr_label")
    return found.select("symbol", "ts", "signal", "level", "reaction", "rr_label_reversal", "rr_label_breakout")


@query("lb05_triple_barrier", f"""WITH {HOURLY}, {_ATR}, {_PATH.format(h=12)}, h AS (SELECT *, {_first('tp', "x.high >= close + 1 * atr")}, {_first('sl', "x.low <= close - 1 * atr")}, len(path) = 12 AND atr IS NOT NULL AS known FROM p),
b AS (SELECT symbol, ts, CASE WHEN known THEN CASE WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN -1 WHEN tp IS NOT NULL THEN 1 ELSE 0 END END AS barrier FROM h) SELECT symbol, ts, barrier, CASE WHEN barrier IS NOT NULL THEN CAST(barrier = 1 AS INTEGER) END AS meta FROM b""")
def _(spark, d):
    return labels.triple_barrier(with_atr(views.hourly(spark, d)), f).select("symbol", "ts", "barrier", "meta")


@query("lb07_lb08_forward_volatility", f"""WITH {HOURLY}, r AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars)
SELECT symbol, ts, CASE WHEN count(ret * ret) OVER n = 12 THEN sqrt(avg(ret * ret) OVER n) END AS fwd_vol, CASE WHEN count(ret * ret) OVER p = 12 THEN sqrt(avg(ret * ret) OVER p) END AS past_vol FROM r
WINDOW n AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    rows = views.hourly(spark, d).withColumn("ret", f.change("close"))
    return labels.forward_volatility(rows, f, "ret", 12).select("symbol", "ts", "fwd_vol", "past_vol")


@query("lb09_quantile_label", f"""WITH {HOURLY}, r AS (SELECT symbol, ts, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd_ret FROM bars),
l AS (SELECT *, list(fwd_ret) FILTER (fwd_ret IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 54 PRECEDING AND 5 PRECEDING) AS past FROM r)
SELECT symbol, ts, fwd_ret, CASE WHEN len(past) = 50 AND fwd_ret IS NOT NULL THEN len(list_filter(past, lambda x: x < fwd_ret)) / 50.0 END AS fwd_quantile FROM l""")
def _(spark, d):
    return labels.quantile_label(views.hourly(spark, d), f, "ret", 5, 50).select("symbol", "ts", "fwd_ret", "fwd_quantile")


@query("lb10_lb11_lb12_lb13_lb19_lb20_path_labels", f"""WITH {HOURLY}, {_ATR}, x AS (SELECT symbol, ts, close, atr, count(high) OVER n = 12 AS full_path, (max(high) OVER n - close) / atr AS mfe, (close - min(low) OVER n) / atr AS mae, (lead(close, 12) OVER (PARTITION BY symbol ORDER BY ts) - close) / atr AS m FROM a
WINDOW n AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)) SELECT symbol, ts, CASE WHEN full_path THEN mfe END AS fwd_mfe, CASE WHEN full_path THEN mae END AS fwd_mae, CASE WHEN full_path THEN mfe - mae END AS fwd_rr, m AS fwd_move,
CAST(m > 0.8 AS INTEGER) AS long_win, CAST(m < -0.8 AS INTEGER) AS short_win, sign(m) * ln(1 + abs(m)) AS log_move, CAST(m < -0.8 AS INTEGER) AS is_bad, CASE WHEN full_path THEN CAST(mae > 1.2 AS INTEGER) END AS failure FROM x""")
def _(spark, d):
    made = labels.path_extremes(with_atr(views.hourly(spark, d)), f, "atr", 12)
    return made.select("symbol", "ts", "fwd_mfe", "fwd_mae", "fwd_rr", "fwd_move", "long_win", "short_win", "log_move", "is_bad", "failure")


@query("sk01_rank_ic", f"""WITH {HOURLY}, x AS (SELECT symbol, ts, volume, taker_buy_ratio, lead(close, 1) OVER s / close - 1 AS fwd_1, lead(close, 5) OVER s / close - 1 AS fwd_5 FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
l AS (SELECT feature, target, x, y FROM (UNPIVOT (UNPIVOT x ON volume, taker_buy_ratio INTO NAME feature VALUE x) ON fwd_1, fwd_5 INTO NAME target VALUE y)),
k AS (SELECT feature, target, rank() OVER (PARTITION BY feature, target ORDER BY x) + (count(*) OVER (PARTITION BY feature, target, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature, target ORDER BY y) + (count(*) OVER (PARTITION BY feature, target, y) - 1) / 2.0 AS b FROM l)
SELECT feature, target, count(*) AS n, corr(a, b) AS ic, corr(a, b) * sqrt((count(*) - 2) / (1 - corr(a, b) ** 2)) AS t FROM k GROUP BY 1, 2 HAVING count(*) >= 100""")
def _(spark, d):
    rows = views.hourly(spark, d).select("volume", "taker_buy_ratio", (f.lead("close") / F.col("close") - 1).alias("fwd_1"), (f.lead("close", 5) / F.col("close") - 1).alias("fwd_5"))
    return stats.rank_ic(rows, ["volume", "taker_buy_ratio"], ["fwd_1", "fwd_5"])


_SCAN = """g AS (SELECT *, min(feature) OVER () AS lo, max(feature) OVER () AS hi FROM scan), c AS (SELECT CAST(least(floor((feature - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS step, any_value(lo) AS lo, any_value(hi) AS hi, count(*) FILTER (is_good) AS good, count(*) FILTER (NOT is_good) AS bad, sum(r) AS r FROM g GROUP BY 1),
s AS (SELECT step, lo + step * (hi - lo) / 40 AS threshold, sum(good) OVER w / sum(good) OVER () AS pass_good, sum(bad) OVER w / sum(bad) OVER () AS pass_bad, CAST(sum(good) OVER w + sum(bad) OVER w AS BIGINT) AS kept, sum(r) OVER w AS r FROM c WINDOW w AS (ORDER BY step DESC ROWS UNBOUNDED PRECEDING))"""


@query("sk05_sk06_sk08_threshold_scan", f"WITH {SCAN}, {_SCAN} SELECT step, threshold, pass_good, pass_bad, CASE WHEN pass_bad >= 0.01 THEN pass_good / pass_bad - 1 END AS lift, kept, r / kept AS mean_r FROM s")
def _(spark, d):
    return stats.threshold_scan(views.scan(spark, d), "feature", "is_good", "r", 40)


@query("sk07_plateau", f"""WITH RECURSIVE {SCAN}, {_SCAN}, v AS (SELECT list(r / kept ORDER BY step) AS v, list(step ORDER BY step) AS numbers FROM s), k AS (SELECT 1 AS i, CAST(1 AS BIGINT) AS head FROM v UNION ALL SELECT i + 1, list_filter(range(head, i + 2), lambda q: abs(v[i + 1] - v[q]) <= 0.05 * abs(v[q]))[1] FROM k, v WHERE i < len(v))
SELECT 'feature >= threshold' AS rule, numbers[head] AS first_step, numbers[i] AS last_step, CAST(i - head + 1 AS INTEGER) AS steps, list_avg(v[head:i]) AS score FROM k, v ORDER BY i - head DESC, i LIMIT 1""")
def _(spark, d):
    scan = stats.threshold_scan(views.scan(spark, d), "feature", "is_good", "r", 40)
    return stats.plateau(scan.withColumn("rule", F.lit("feature >= threshold")), ["rule"], "mean_r", 0.05)


@query("sk12_stability_index", f"""WITH {SCAN}, ref AS (SELECT feature FROM scan WHERE date < DATE '1998-01-01'), cur AS (SELECT feature FROM scan WHERE date >= DATE '1998-01-01'),
e AS (SELECT list_distinct(quantile_cont(feature, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM ref), a AS (SELECT len(list_filter(e, lambda x: feature > x)) AS bin, count(*) AS a FROM ref, e GROUP BY 1), b AS (SELECT len(list_filter(e, lambda x: feature > x)) AS bin, count(*) AS b FROM cur, e GROUP BY 1),
j AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (bin)), p AS (SELECT a, b, greatest(a / sum(a) OVER (), 1e-6) AS pa, greatest(b / sum(b) OVER (), 1e-6) AS pb FROM j) SELECT CAST(sum(a) AS BIGINT) AS n_reference, CAST(sum(b) AS BIGINT) AS n_current, sum((pb - pa) * ln(pb / pa)) AS psi FROM p""")
def _(spark, d):
    rows = views.scan(spark, d)
    return stats.stability_index(rows.where("date < date '1998-01-01'"), rows.where("date >= date '1998-01-01'"), "feature")


@query("sk15_sk16_strata", f"""WITH {SCAN}, g AS (SELECT symbol, count(*) FILTER (feature >= 30) AS n_signal, count(*) FILTER (feature < 30) AS n_rest, avg(CAST(NOT is_good AS INTEGER)) FILTER (feature >= 30) AS bad_signal, avg(CAST(NOT is_good AS INTEGER)) FILTER (feature < 30) AS bad_rest,
median(r) FILTER (feature >= 30) AS median_signal, median(r) FILTER (feature < 30) AS median_rest FROM scan GROUP BY symbol), p AS (SELECT *, (bad_signal * n_signal + bad_rest * n_rest) / (n_signal + n_rest) AS p FROM g)
SELECT symbol, n_signal, n_rest, bad_signal, bad_rest, median_signal, median_rest, CASE WHEN n_signal > 0 AND n_rest > 0 AND p * (1 - p) > 0 THEN (bad_signal - bad_rest) / sqrt(p * (1 - p) * (1.0 / n_signal + 1.0 / n_rest)) END AS z FROM p""")
def _(spark, d):
    return stats.strata(views.scan(spark, d), ["symbol"], "feature", 30.0, "is_good", "r")


@query("sk17_out_of_range", f"""WITH {SCAN}, b AS (SELECT quantile_cont(feature, 0.05) AS f0, quantile_cont(feature, 0.95) AS f1, quantile_cont(r, 0.05) AS r0, quantile_cont(r, 0.95) AS r1 FROM scan WHERE date < DATE '1998-01-01')
SELECT k1, k2, symbol, date, (CASE WHEN feature < f0 OR feature > f1 THEN 1 ELSE 0 END + CASE WHEN r < r0 OR r > r1 THEN 1 ELSE 0 END) / 2.0 AS ood FROM scan, b""")
def _(spark, d):
    rows = views.scan(spark, d)
    return stats.out_of_range(rows, rows.where("date < date '1998-01-01'"), ["k1", "k2", "symbol", "date"], ["feature", "r"])


@query("sk20_gate_effect", f"""WITH {SCAN}, s AS (SELECT *, feature > 40 AS v, r - 0.04 AS p FROM scan), q AS (SELECT symbol, quantile_cont(p, 0.1) FILTER (v) AS qv, quantile_cont(p, 0.1) FILTER (NOT v) AS qa FROM s GROUP BY symbol)
SELECT symbol, avg(CAST(v AS INTEGER)) AS activation, avg(p) FILTER (v) - avg(p) FILTER (NOT v) AS mean_gap, avg(CAST(p > 0 AS INTEGER)) FILTER (v) AS vetoed_winners, round(avg(p) FILTER (v AND p <= qv) - avg(p) FILTER (NOT v AND p <= qa), 9) + 0.0 AS tail_gap FROM s JOIN q USING (symbol) GROUP BY symbol""")
def _(spark, d):
    rows = views.scan(spark, d).withColumn("p", F.col("r") - 0.04)
    return stats.gate_effect(rows, ["symbol"], F.col("feature") > 40, "p").withColumn("tail_gap", F.round("tail_gap", 9) + 0.0)


@query("sk21_asset_figures", f"""WITH {DAILY}, r AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM daily), x AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS eq, quantile_cont(ret, 0.05) OVER (PARTITION BY symbol) AS q FROM r WHERE ret IS NOT NULL),
y AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM x) SELECT symbol, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(ret) FILTER (ret <= q) AS cvar_5, min(dd) AS max_drawdown FROM y GROUP BY symbol""")
def _(spark, d):
    from tidemark.operators.panels import BY_DAY

    rows = views.daily(spark, d).select("symbol", "date", BY_DAY.change("close").alias("ret"))
    return stats.asset_figures(rows, ["symbol"], "ret", ("date",))


@query("sk24_expanding_months", f"WITH {DAILY}, m AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM daily) SELECT month, count(*) OVER w AS train_months, min(month) OVER w AS train_from, max(month) OVER w AS train_to FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return stats.expanding_months(views.daily(spark, d), "date")


@query("sk25_auc", f"""WITH {SCAN}, k AS (SELECT symbol, is_good, rank() OVER (PARTITION BY symbol ORDER BY feature) + (count(*) OVER (PARTITION BY symbol, feature) - 1) / 2.0 AS k FROM scan), g AS (SELECT symbol, count(*) FILTER (is_good) AS n1, count(*) FILTER (NOT is_good) AS n0, sum(k) FILTER (is_good) AS s FROM k GROUP BY symbol)
SELECT symbol, n1, n0, (s - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM g""")
def _(spark, d):
    return stats.area_under_curve(views.scan(spark, d), ["symbol"], "feature", "is_good")


@query("sk26_pf14_trade_results", f"""WITH {TRADES}, c AS (SELECT *, sum(pnl_r) OVER w AS run FROM trades WINDOW w AS (PARTITION BY symbol, side ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)), x AS (SELECT *, greatest(0, max(run) OVER w) - run AS dd FROM c WINDOW w AS (PARTITION BY symbol, side ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING))
SELECT symbol, side, count(*) AS n, avg(CAST(pnl_r > 0 AS INTEGER)) AS win_rate, avg(pnl_r) AS mean_r, sum(pnl_r) AS total_r, avg(pnl_r) / stddev_samp(pnl_r) AS sharpe_r, max(dd) AS max_drawdown_r FROM x GROUP BY 1, 2""")
def _(spark, d):
    return stats.trade_results(views.trades(spark, d), ["symbol", "side"])


@query("sk23_purged_rows", f"""WITH {TRADES}, v AS (SELECT min(entry_time) AS a, max(exit_time) AS b FROM trades WHERE entry_time BETWEEN DATE '1997-01-01' AND DATE '1997-06-30') SELECT trade_id, entry_time, exit_time FROM trades, v WHERE exit_time < a OR entry_time > b""")
def _(spark, d):
    t = views.trades(spark, d).select("trade_id", "entry_time", "exit_time")
    return stats.purged(t, t.where("entry_time BETWEEN date '1997-01-01' AND date '1997-06-30'"), "entry_time", "exit_time")
