"""Weekly columns on daily rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import weekly
from tidemark.plans.register import query
from tidemark.sources import views
from tidemark.sources.views import DAILY

_W = "PARTITION BY symbol ORDER BY week_end"
_LAST = f"{_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW"


@query("fx167_fx175_weekly_positions", f"""WITH RECURSIVE {DAILY}, w0 AS (SELECT symbol, date + CAST((7 - isodow(date)) AS INTEGER) AS week_end, arg_max(close, date) AS close, max(high) AS high, min(low) AS low FROM daily GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER ({_W}) AS k FROM w0),
e AS (SELECT symbol, k, close AS e50, close AS e200 FROM w WHERE k = 1 UNION ALL SELECT w.symbol, w.k, e.e50 + 2.0 / 51 * (w.close - e.e50), e.e200 + 2.0 / 201 * (w.close - e.e200) FROM e JOIN w ON w.symbol = e.symbol AND w.k = e.k + 1),
m AS (SELECT w.*, CASE WHEN k >= 50 THEN e50 END AS e50, CASE WHEN k >= 200 THEN e200 END AS e200 FROM w JOIN e USING (symbol, k)),
x AS (SELECT *, CASE WHEN close < e50 THEN 1 ELSE 0 END AS under, CASE WHEN high < lag(high) OVER ({_W}) AND low < lag(low) OVER ({_W}) THEN 1 ELSE 0 END AS lower FROM m),
f AS (SELECT *, CASE WHEN sum(under) OVER ({_LAST}) = 2 THEN 1.0 ELSE 0.0 END AS b, CASE WHEN sum(lower) OVER ({_LAST}) = 2 THEN 1.0 ELSE 0.0 END AS l FROM x)
SELECT d.symbol, CAST(d.date AS TIMESTAMP) AS ts, greatest(least((d.close - f.e50) / d.close, CASE WHEN f.e50 IS NOT NULL THEN 1.0 END), CASE WHEN f.e50 IS NOT NULL THEN -1.0 END) AS weekly_ema_50_position, greatest(least((d.close - f.e200) / d.close, CASE WHEN f.e200 IS NOT NULL THEN 1.0 END), CASE WHEN f.e200 IS NOT NULL THEN -1.0 END) AS weekly_ema_200_position,
CAST(coalesce(f.b, 0) AS DOUBLE) AS weekly_close_below, CAST(coalesce(f.l, 0) AS DOUBLE) AS weekly_lower_high_lower_low, CAST(coalesce(f.b * f.l, 0) AS DOUBLE) AS weekly_macro_cycle_exit_signal
FROM daily d ASOF LEFT JOIN f ON d.symbol = f.symbol AND f.week_end < d.date""")
def _(spark, d):
    """Where the close is to the weekly means, and the weekly exit flags, of weeks that are over."""
    rows = views.daily(spark, d).withColumn("ts", F.col("date").cast("timestamp"))
    return weekly.positions(rows.select("symbol", "ts", "open", "high", "low", "close", "volume"))
