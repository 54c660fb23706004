"""Liquidity voids: fast moves on little volume, and what follows them as labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import recursive
from tidemark.operators import labels
from tidemark.operators.bars import BY_TIME as f
from tidemark.plans.bar_features import RECURSIVE
from tidemark.plans.register import query
from tidemark.sources import views


def liquidity_voids(rows: DataFrame, n: int = 20, times: float = 2.0, thin: float = 0.2) -> DataFrame:
    """rows (with atr) and liquidity_void_detected, _speed, _volume_ratio, _price_impact.

    A void is a bar whose mean return of three in ATR is over `times` its mean of n, on a
    volume under the `thin` quantile of n or 0.8 of their mean. Elsewhere speed and impact are 0, the ratio 1.
    """
    yard = F.greatest(F.coalesce("atr", F.lit(0.0)), F.lit(1e-8)) / F.col("close") + 1e-8
    rows = rows.withColumn("_change", f.change("close"))
    rows = rows.withColumns({"_speed": f.mean("_change", 3) / yard, "_ratio": F.col("volume") / (f.mean("volume", n) + 1e-8), "_thin": F.col("volume") < f.quantile("volume", n, thin), "_impact": F.coalesce(f.max("close", 3) - f.min("close", 3), F.lit(0.0)) / (F.col("volume") + 1e-8)})
    void = F.coalesce((F.col("_speed") > times * f.mean("_speed", n)) & (F.col("_thin") | (F.col("_ratio") < 0.8)), F.lit(False))
    rows = rows.withColumn("liquidity_void_detected", void.cast("double"))
    pick = lambda c, other: F.when(F.col("liquidity_void_detected") == 1, F.col(c)).otherwise(other)
    found = rows.withColumns({"liquidity_void_speed": pick("_speed", 0.0), "liquidity_void_volume_ratio": pick("_ratio", 1.0), "liquidity_void_price_impact": pick("_impact", 0.0)})
    return found.drop("_change", "_speed", "_ratio", "_thin", "_impact")


_S = "PARTITION BY symbol ORDER BY ts"
_full = lambda e, x, n: f"CASE WHEN count({x}) OVER ({_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN {e} OVER ({_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


@query("fx049_liquidity_void", f"""WITH RECURSIVE {RECURSIVE}, c AS (SELECT *, close / lag(close) OVER ({_S}) - 1 AS change FROM seq),
s AS (SELECT *, {_full('avg(change)', 'change', 3)} / (greatest(coalesce(atr, 0), 1e-8) / close + 1e-8) AS speed, volume / ({_full('avg(volume)', 'volume', 20)} + 1e-8) AS ratio, volume < {_full('quantile_cont(volume, 0.2)', 'volume', 20)} AS thin,
coalesce({_full('max(close)', 'close', 3)} - {_full('min(close)', 'close', 3)}, 0) / (volume + 1e-8) AS impact, count(close) OVER a AS ahead, greatest(max(close) OVER a / close - 1, 1 - min(close) OVER a / close) AS size FROM c WINDOW a AS ({_S} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
v AS (SELECT *, coalesce(speed > 2 * {_full('avg(speed)', 'speed', 20)} AND (thin OR ratio < 0.8), false) AS void FROM s)
SELECT symbol, ts, CAST(void AS DOUBLE) AS liquidity_void_detected, CASE WHEN void THEN speed ELSE 0 END AS liquidity_void_speed, CASE WHEN void THEN ratio ELSE 1 END AS liquidity_void_volume_ratio, CASE WHEN void THEN impact ELSE 0 END AS liquidity_void_price_impact,
CASE WHEN void AND ahead = 3 THEN size ELSE 0 END AS label_retracement, CASE WHEN void AND ahead = 3 THEN CASE WHEN size > 5e-1 THEN 8e-1 WHEN size > 3e-1 THEN 5e-1 ELSE 2e-1 END ELSE 0e0 END AS label_false_breakout_risk FROM v""")
def _(spark, d):
    """Voids of hourly bars; the columns label_ read the next three bars."""
    rows = labels.retracement(liquidity_voids(recursive.with_indicators(views.hourly(spark, d))), f, "liquidity_void_detected")
    names = ("liquidity_void_detected", "liquidity_void_speed", "liquidity_void_volume_ratio", "liquidity_void_price_impact")
    return rows.select("symbol", "ts", *names, F.col("retracement").alias("label_retracement"), F.col("false_breakout_risk").alias("label_false_breakout_risk"))
