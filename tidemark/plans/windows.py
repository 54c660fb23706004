"""Window functions over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.frames import cross_rank, cross_scale, cross_z
from tidemark.operators.bars import BY_TIME as f
from tidemark.plans.register import query
from tidemark.sources import views
from tidemark.sources.views import HOURLY


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(expr: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {_w(n)} >= {n} THEN {expr} OVER {_w(n)} END"


_S = "PARTITION BY symbol ORDER BY ts"


@query("wn01_lag_sum_mean_std", f"""WITH {HOURLY} SELECT symbol, ts, lag(close, 3) OVER ({_S}) AS lag_3, close - lag(close) OVER ({_S}) AS delta_1, {_full('sum(volume)', 'volume', 5)} AS sum_5, {_full('avg(close)', 'close', 20)} AS mean_20,
{_full('stddev_samp(close)', 'close', 20)} AS std_20, {_full('min(low)', 'low', 10)} AS min_10, {_full('max(high)', 'high', 10)} AS max_10 FROM bars""")
def _(spark, d):
    return views.hourly(spark, d).select("symbol", "ts", f.lag("close", 3).alias("lag_3"), f.delta("close").alias("delta_1"), f.sum("volume", 5).alias("sum_5"), f.mean("close", 20).alias("mean_20"), f.std("close", 20).alias("std_20"), f.min("low", 10).alias("min_10"), f.max("high", 10).alias("max_10"))


def _list(c: str, n: int) -> str:
    return f"list({c}) OVER {_w(n)}"


@query("wn02_wn03_wn04_wn05_order_in_window", f"""WITH {HOURLY}, l AS (SELECT symbol, ts, close, {_list('close', 10)} AS x, {_list('close / 100', 5)} AS y FROM bars)
SELECT symbol, ts, CASE WHEN len(x) = 10 THEN CAST(list_position(x, list_max(x)) AS DOUBLE) END AS argmax_10, CASE WHEN len(x) = 10 THEN CAST(list_position(x, list_min(x)) AS DOUBLE) END AS argmin_10,
CASE WHEN len(x) = 10 THEN len(list_filter(x, lambda v: v < close)) + (len(list_filter(x, lambda v: v = close)) + 1) / 2.0 END AS rank_10,
CASE WHEN len(x) = 10 THEN list_sum(list_transform(x, lambda v, i: v * i)) / 55 END AS decay_10, CASE WHEN len(y) = 5 THEN list_product(y) END AS product_5 FROM l""")
def _(spark, d):
    return views.hourly(spark, d).select("symbol", "ts", f.arg(F.array_max, "close", 10).alias("argmax_10"), f.arg(F.array_min, "close", 10).alias("argmin_10"), f.rank_last("close", 10).alias("rank_10"), f.decay("close", 10).alias("decay_10"), f.product(F.col("close") / 100, 5).alias("product_5"))


@query("wn06_corr_cov", f"WITH {HOURLY} SELECT symbol, ts, {_full('corr(close, volume)', 'close', 20)} AS corr_20, {_full('covar_samp(close, volume)', 'close', 20)} AS cov_20 FROM bars")
def _(spark, d):
    return views.hourly(spark, d).select("symbol", "ts", f.corr("close", "volume", 20).alias("corr_20"), f.cov("close", "volume", 20).alias("cov_20"))


@query("wn07_wn08_cross_section", f"""WITH {HOURLY} SELECT symbol, ts, (rank() OVER (PARTITION BY ts ORDER BY close) + (count(*) OVER (PARTITION BY ts, close) - 1) / 2.0) / count(*) OVER (PARTITION BY ts) AS cs_rank,
volume / sum(abs(volume)) OVER (PARTITION BY ts) AS cs_scale, CASE WHEN stddev_samp(close) OVER (PARTITION BY ts) > 0 THEN (close - avg(close) OVER (PARTITION BY ts)) / stddev_samp(close) OVER (PARTITION BY ts) END AS cs_z FROM bars""")
def _(spark, d):
    return views.hourly(spark, d).select("symbol", "ts", cross_rank("close", "ts").alias("cs_rank"), cross_scale("volume", "ts").alias("cs_scale"), cross_z("close", "ts").alias("cs_z"))


@query("wn09_rank_in_history", f"""WITH {HOURLY}, l AS (SELECT symbol, ts, close, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS x FROM bars),
p AS (SELECT symbol, ts, CASE WHEN len(x) = 60 THEN len(list_filter(x, lambda v: v <= close)) / 60.0 END AS pct FROM l) SELECT symbol, ts, lag(pct) OVER ({_S}) AS pct_lag1 FROM p""")
def _(spark, d):
    rows = views.hourly(spark, d).withColumn("pct", f.rank_in_history("close", 60))
    return rows.select("symbol", "ts", f.lag("pct").alias("pct_lag1"))


@query("wn10_rolling_quantile", f"WITH {HOURLY} SELECT symbol, ts, {_full('quantile_cont(close, 0.99)', 'close', 50)} AS p99_50, {_full('quantile_cont(close, 0.25)', 'close', 50)} AS p25_50 FROM bars")
def _(spark, d):
    return views.hourly(spark, d).select("symbol", "ts", f.quantile("close", 50, 0.99).alias("p99_50"), f.quantile("close", 50, 0.25).alias("p25_50"))


@query("wn11_zscore", f"""WITH {HOURLY} SELECT symbol, ts, CASE WHEN count(close) OVER {_w(50)} >= 50 AND stddev_samp(close) OVER {_w(50)} > 0 THEN (close - avg(close) OVER {_w(50)}) / stddev_samp(close) OVER {_w(50)} END AS z_50,
CASE WHEN count(close) OVER v >= 20 AND stddev_samp(close) OVER v > 0 THEN (close - avg(close) OVER v) / stddev_samp(close) OVER v END AS z_20_shift FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    return views.hourly(spark, d).select("symbol", "ts", f.zscore("close", 50).alias("z_50"), f.zscore("close", 20, shift=1).alias("z_20_shift"))


@query("wn12_robust_zscore", f"""WITH {HOURLY}, l AS (SELECT symbol, ts, close, {_list('close', 50)} AS x, median(close) OVER {_w(50)} AS m FROM bars), q AS (SELECT *, list_median(list_transform(x, lambda v: abs(v - m))) AS mad FROM l)
SELECT symbol, ts, CASE WHEN len(x) >= 50 AND mad > 0 THEN (close - m) / (1.4826 * mad) END AS robust_z FROM q""")
def _(spark, d):
    return views.hourly(spark, d).select("symbol", "ts", f.robust_z("close", 50).alias("robust_z"))


@query("wn14_rolling_regression", f"""WITH {HOURLY}, n AS (SELECT *, CAST(row_number() OVER ({_S}) AS DOUBLE) AS k FROM bars) SELECT symbol, ts, {_full('regr_slope(close, k)', 'close', 20)} AS slope_20, {_full('regr_r2(close, k)', 'close', 20)} AS r2_20 FROM n""")
def _(spark, d):
    rows = views.hourly(spark, d).withColumn("k", F.row_number().over(f.ordered).cast("double"))
    return rows.select("symbol", "ts", f.slope("close", "k", 20).alias("slope_20"), f.r2("close", "k", 20).alias("r2_20"))


@query("wn15_drawdown", f"WITH {HOURLY} SELECT symbol, ts, max(close) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS peak, close / max(close) OVER ({_S} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM bars")
def _(spark, d):
    return views.hourly(spark, d).select("symbol", "ts", F.max("close").over(f.so_far).alias("peak"), f.drawdown("close").alias("drawdown"))


@query("wn16_run_length", f"""WITH {HOURLY}, i AS (SELECT *, sum(CASE WHEN close > open THEN 0 ELSE 1 END) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS island FROM bars)
SELECT symbol, ts, CASE WHEN close > open THEN CAST(sum(CASE WHEN close > open THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS up_run FROM i""")
def _(spark, d):
    from pyspark.sql import Window

    up = F.col("close") > F.col("open")
    rows = views.hourly(spark, d).withColumn("island", f.island(up))
    w = Window.partitionBy("symbol", "island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("symbol", "ts", F.when(up, F.sum(up.cast("int")).over(w)).otherwise(0).alias("up_run"))


@query("wn18_bars_since_high", f"WITH {HOURLY}, l AS (SELECT symbol, ts, {_list('high', 24)} AS x FROM bars) SELECT symbol, ts, CASE WHEN len(x) = 24 THEN 24.0 - list_position(x, list_max(x)) END AS since_high FROM l")
def _(spark, d):
    return views.hourly(spark, d).select("symbol", "ts", f.since_extreme(F.array_max, "high", 24).alias("since_high"))


@query("wn19_cross_flags", f"""WITH {HOURLY}, m AS (SELECT symbol, ts, {_full('avg(close)', 'close', 5)} AS a, {_full('avg(close)', 'close', 20)} AS b FROM bars)
SELECT symbol, ts, coalesce(lag(a) OVER ({_S}) <= lag(b) OVER ({_S}) AND a > b, false) AS golden, coalesce(lag(b) OVER ({_S}) <= lag(a) OVER ({_S}) AND b > a, false) AS death FROM m""")
def _(spark, d):
    rows = views.hourly(spark, d).select("symbol", "ts", f.mean("close", 5).alias("a"), f.mean("close", 20).alias("b"))
    return rows.select("symbol", "ts", f.crosses_above("a", "b").alias("golden"), f.crosses_above("b", "a").alias("death"))


@query("wn20_forward_fill", f"WITH {HOURLY}, n AS (SELECT symbol, ts, CASE WHEN trade_count > 1 THEN close END AS x FROM bars) SELECT symbol, ts, last_value(x IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS filled FROM n")
def _(spark, d):
    rows = views.hourly(spark, d).select("symbol", "ts", F.when(F.col("trade_count") > 1, F.col("close")).alias("x"))
    return rows.select("symbol", "ts", f.filled("x").alias("filled"))


@query("wn21_position_equity", f"""WITH {HOURLY}, p AS (SELECT symbol, ts, close / lag(close) OVER ({_S}) - 1 AS r, CASE WHEN close > open THEN 1 ELSE -1 END AS pos FROM bars), q AS (SELECT *, lag(pos) OVER ({_S}) AS held FROM p)
SELECT symbol, ts, held, sum(held * r) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS equity FROM q""")
def _(spark, d):
    rows = views.hourly(spark, d).select("symbol", "ts", f.change("close").alias("r"), F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("pos"))
    rows = rows.withColumn("held", f.lag("pos"))
    return rows.select("symbol", "ts", "held", F.sum(F.col("held") * F.col("r")).over(f.so_far).alias("equity"))
