"""Feature columns over hourly bars; the recursive inputs come from one pass a symbol, in SQL from a recursive query."""

from __future__ import annotations

from tidemark.functions import bar_features, recursive
from tidemark.operators import bars
from tidemark.plans.market import BUCKETS
from tidemark.plans.register import query
from tidemark.sources import views
from tidemark.sources.views import HOURLY

_S = "PARTITION BY symbol ORDER BY ts"


def _mean(x: str, n: int) -> str:
    return f"avg({x}) OVER ({_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _smooth(name: str, n: int, weight: str, x: str, first: int) -> str:
    """The recursion of an exponential mean that bar `first` seeds by the mean of n values."""
    return f"CASE WHEN n.k < {first} THEN NULL WHEN n.k = {first} THEN n.{name}_seed ELSE q.{name} + {weight} * (n.{x} - q.{name}) END"


#: name: values in the seed, weight, input, bar of the seed
_MEANS = {
    **{f"ema_{n}": (n, f"2e0 / {n + 1}", "close", n) for n in (50, 200, 1200)}, "fast": (12, "2e0 / 13", "close", 26), "slow": (26, "2e0 / 27", "close", 26), "fixed_fast": (12, "15e-2", "close", 26), "fixed_slow": (26, "75e-3", "close", 26),
    "atr": (14, "1e0 / 14", "tr", 15), "gain": (14, "1e0 / 14", "up", 15), "loss": (14, "1e0 / 14", "down", 15), "atr_200": (200, "1e0 / 200", "tr", 201), "plus_200": (200, "1e0 / 200", "plus", 201), "minus_200": (200, "1e0 / 200", "minus", 201),
}
_WEIGHTED = {"ewm_10": (10, "close"), "ewm_20": (20, "close"), "ewm_50": (50, "close"), "volume_ewm": (20, "volume")}


def _turn(what: str) -> str:
    """The next state of the zigzag: its trend, pivot, high or low."""
    rise, fall = "n.high >= q.pivot * 105e-2", "n.low <= q.pivot * 95e-2"
    value = {"trend": ("1", "-1", "q.trend"), "pivot": ("n.high", "n.low", "q.pivot"), "zz_high": ("n.high", "q.zz_high", "q.zz_high"), "zz_low": ("q.zz_low", "n.low", "q.zz_low")}[what]
    return (
        f"CASE WHEN q.trend = 0 THEN CASE WHEN {rise} THEN {value[0]} WHEN {fall} THEN {value[1]} ELSE {value[2]} END WHEN q.trend = 1 THEN CASE WHEN {fall} THEN {value[1]} WHEN n.high >= q.pivot THEN {value[0]} ELSE {value[2]} END "
        f"ELSE CASE WHEN {rise} THEN {value[0]} WHEN n.low <= q.pivot THEN {value[1]} ELSE {value[2]} END END"
    )


_signal = lambda fast, slow, sum_, signal: (f"CASE WHEN n.k < 26 THEN NULL WHEN n.k <= 34 THEN coalesce(q.{sum_}, 0) + {fast} - {slow} END", f"CASE WHEN n.k < 34 THEN NULL WHEN n.k = 34 THEN (q.{sum_} + {fast} - {slow}) / 9 ELSE q.{signal} + 2e0 / 10 * ({fast} - {slow} - q.{signal}) END")
_means = {name: _smooth(name, n, w, x, first) for name, (n, w, x, first) in _MEANS.items()}
_next = {
    **_means, **{f"{k}_top": f"n.{x} + (1 - 2e0 / {n + 1}) * q.{k}_top" for k, (n, x) in _WEIGHTED.items()}, **{f"{k}_bottom": f"1 + (1 - 2e0 / {n + 1}) * q.{k}_bottom" for k, (n, x) in _WEIGHTED.items()}, **{x: _turn(x) for x in ("trend", "pivot", "zz_high", "zz_low")},
    **dict(zip(("macd_sum", "macd_signal"), _signal(_means["fast"], _means["slow"], "macd_sum", "macd_signal"))), **dict(zip(("fixed_sum", "macdfix_signal"), _signal(_means["fixed_fast"], _means["fixed_slow"], "fixed_sum", "macdfix_signal"))),
}
_first = {**{k: "CAST(NULL AS DOUBLE)" for k in _next}, **{f"{k}_top": f"CAST({x} AS DOUBLE)" for k, (_, x) in _WEIGHTED.items()}, **{f"{k}_bottom": "CAST(1 AS DOUBLE)" for k in _WEIGHTED}, "trend": "0", "pivot": "high", "zz_high": "high", "zz_low": "high"}

#: bars with the recursive columns that features use.
RECURSIVE = f"""{HOURLY}, m0 AS (SELECT *, CAST(row_number() OVER ({_S}) AS BIGINT) AS k, lag(close) OVER ({_S}) AS pc, lag(high) OVER ({_S}) AS ph, lag(low) OVER ({_S}) AS pl FROM bars),
m1 AS (SELECT *, CASE WHEN k > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN k > 1 THEN greatest(close - pc, 0) END AS up, CASE WHEN k > 1 THEN greatest(pc - close, 0) END AS down,
CASE WHEN k > 1 THEN CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END END AS plus, CASE WHEN k > 1 THEN CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END END AS minus FROM m0),
m AS (SELECT *, {', '.join(f'{_mean(x, n)} AS {name}_seed' for name, (n, _, x, _) in _MEANS.items())} FROM m1),
q AS (SELECT symbol, k, {', '.join(f'{x} AS {k}' for k, x in _first.items())} FROM m WHERE k = 1 UNION ALL SELECT n.symbol, n.k, {', '.join(f'{x} AS {k}' for k, x in _next.items())} FROM q JOIN m n ON n.symbol = q.symbol AND n.k = q.k + 1),
seq AS (SELECT m.symbol, m.ts, m.open, m.high, m.low, m.close, m.volume, m.trade_count, m.buy_qty, m.sell_qty, m.taker_buy_ratio, q.atr, q.ema_50, q.ema_200, q.ema_1200, {', '.join(f'q.{k}_top / q.{k}_bottom AS {k}' for k in ('ewm_10', 'ewm_20', 'ewm_50'))},
CASE WHEN k >= 10 THEN q.volume_ewm_top / q.volume_ewm_bottom END AS volume_ewm_20, CASE WHEN q.gain IS NOT NULL THEN CASE WHEN q.gain + q.loss > 0 THEN 100 * q.gain / (q.gain + q.loss) ELSE 50 END END AS rsi, CASE WHEN q.gain IS NOT NULL THEN CASE WHEN q.gain + q.loss > 0 THEN 100 * (q.gain - q.loss) / (q.gain + q.loss) ELSE 0 END END AS cmo, q.fast - q.slow AS macd, q.macd_signal, q.fixed_fast - q.fixed_slow AS macdfix, q.macdfix_signal,
100 * q.plus_200 / nullif(q.atr_200, 0) AS plus_di_200, 100 * q.minus_200 / nullif(q.atr_200, 0) AS minus_di_200, q.pivot AS zigzag, q.zz_high, q.zz_low FROM m JOIN q USING (symbol, k))"""


def _register(name: str) -> None:
    features = bar_features.FEATURES[name]

    @query(name, f"WITH RECURSIVE {RECURSIVE}{bar_features.as_sql(features, 'seq', ties=True)}")
    def _(spark, d):
        return bar_features.with_features(recursive.with_indicators(views.hourly(spark, d)), features, ties=True)


for _name in bar_features.FEATURES:
    _register(_name)

#: The recursive columns, and the buckets and runs of `bars.with_flow`: a run counts while it began within the last 100 steps; the current one always does.
FLOW = f"""{RECURSIVE}, {BUCKETS}, v0 AS (SELECT symbol, bucket, ended, avg(imbalance) OVER b AS v, avg((buy - sell) / 500) OVER b AS s FROM f WINDOW b AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
v1 AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ended) AS ts, arg_max(v, bucket) AS vpin, arg_max(s, bucket) AS vpin_signed_imbalance FROM v0 GROUP BY 1, 2),
o0 AS (SELECT symbol, ts, seq, CASE WHEN count(*) OVER w = 100 AND sum(volume) OVER w > 0 THEN 2 * sum(CASE WHEN side = 1 THEN volume ELSE 0 END) OVER w / sum(volume) OVER w - 1 ELSE 0 END AS ofci FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
o1 AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_max(ofci, (ts, seq)) AS ofci FROM o0 GROUP BY 1, 2),
s0 AS (SELECT symbol, ts, CASE WHEN sum(side * volume) >= 0 THEN 1 ELSE -1 END AS side FROM ticks GROUP BY 1, 2), s1 AS (SELECT *, row_number() OVER ({_S}) AS i, CASE WHEN side = lag(side) OVER ({_S}) THEN 0 ELSE 1 END AS fresh FROM s0),
r0 AS (SELECT symbol, side, i AS first, lead(i) OVER (PARTITION BY symbol ORDER BY i) AS next FROM s1 WHERE fresh = 1), e AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bar, max(i) AS i FROM s1 GROUP BY 1, 2),
ln AS (SELECT e.symbol, e.bar AS ts, r.side, least(least(coalesce(r.next, e.i + 1), e.i + 1) - r.first, 100) AS n FROM e JOIN r0 r ON r.symbol = e.symbol AND r.first <= e.i AND (r.first > e.i - 100 OR coalesce(r.next, e.i + 1) > e.i)),
gr AS (SELECT symbol, ts, coalesce(max(n) FILTER (side = 1), 0) / 100 AS max_buy_run, coalesce(max(n) FILTER (side = -1), 0) / 100 AS max_sell_run, coalesce(avg(n) FILTER (side = 1), 0) / 100 AS avg_buy_run, coalesce(avg(n) FILTER (side = -1), 0) / 100 AS avg_sell_run,
count(*) FILTER (side = 1) / 100 AS buy_run_count, count(*) FILTER (side = -1) / 100 AS sell_run_count, (count(*) FILTER (side = 1) - count(*) FILTER (side = -1)) / count(*) AS imbalance_ratio, count(*) FILTER (side = 1) / count(*) AS up FROM ln GROUP BY 1, 2),
fl AS (SELECT q.*, {', '.join(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY q.symbol ORDER BY q.ts ROWS UNBOUNDED PRECEDING) AS {c}' for c in ('vpin', 'vpin_signed_imbalance', 'ofci', 'max_buy_run', 'max_sell_run', 'avg_buy_run', 'avg_sell_run', 'buy_run_count', 'sell_run_count', 'imbalance_ratio'))},
last_value(CASE WHEN up > 0 AND up < 1 THEN -up * log2(up) - (1 - up) * log2(1 - up) WHEN up IS NOT NULL THEN 0 END IGNORE NULLS) OVER (PARTITION BY q.symbol ORDER BY q.ts ROWS UNBOUNDED PRECEDING) AS directional_entropy FROM seq q LEFT JOIN v1 USING (symbol, ts) LEFT JOIN gr USING (symbol, ts) LEFT JOIN o1 USING (symbol, ts))"""


def _register_flow(name: str) -> None:
    features = bar_features.FLOW_FEATURES[name]

    @query(name, f"WITH RECURSIVE {FLOW}{bar_features.as_sql(features, 'fl', ties=True)}")
    def _(spark, d):
        rows = bars.with_flow(recursive.with_indicators(views.hourly(spark, d)), views.ticks(spark, d), "1 hour", 500.0)
        return bar_features.with_features(rows, features, ties=True)


for _name in bar_features.FLOW_FEATURES:
    _register_flow(_name)
