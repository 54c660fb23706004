"""Feature and indicator columns over hourly bars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import filters, recursive
from tidemark.functions.catalog import add, listed
from tidemark.operators import stats
from tidemark.operators.bars import BY_TIME as f
from tidemark.plans.register import query
from tidemark.plans.windows import _full, _list, _S
from tidemark.sources import views
from tidemark.sources.views import HOURLY


class _Bar:
    """A bar's columns, made when they are asked for: this module is read before any session exists."""

    def __getattr__(self, name: str):
        short = {"c": "close", "h": "high", "l": "low", "o": "open", "v": "volume"}
        return F.col("high") - F.col("low") if name == "span" else F.col(short[name])


b = _Bar()


# --- the catalog: features by name, with what they need ------------------------------------
add("wick_upper", "price", ["open", "high", "low", "close"], lambda: F.when(b.span > 0, (b.h - F.greatest(b.o, b.c)) / b.span).otherwise(0.0))
add("wick_lower", "price", ["open", "high", "low", "close"], lambda: F.when(b.span > 0, (F.least(b.o, b.c) - b.l) / b.span).otherwise(0.0))
add("change_5", "price", ["close"], lambda: f.change("close", 5))
add("swing_high", "price", ["high"], lambda: F.max("high").over(f.ordered.rowsBetween(-24, -4)))
add("range_volume", "interaction", ["high", "low", "close", "volume"], lambda: F.coalesce(b.span / b.c * F.log1p("volume"), F.lit(0.0)))
add("imbalance_range", "interaction", ["high", "low", "taker_buy_ratio"], lambda: F.coalesce((F.col("taker_buy_ratio") - 0.5) * b.span, F.lit(0.0)))


# --- ranks over everything -------------------------------------------------------------------
@query("fx143_fx148_global_rank", f"""WITH {HOURLY}, x AS (SELECT symbol, ts, (taker_buy_ratio - 0.5) * volume AS x FROM bars), k AS (SELECT *, (rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2.0) / count(*) OVER () AS k FROM x) SELECT symbol, ts, coalesce(k, 0.5) AS global_rank, sign(x) * k AS signed_rank FROM k""")
def _(spark, d):
    x = views.hourly(spark, d).select("symbol", "ts", ((F.col("taker_buy_ratio") - 0.5) * b.v).alias("x"))
    ranked = stats.ranks_of_values(x.select(F.abs("x").alias("a")), "a")
    return x.join(ranked, F.abs(x["x"]) == ranked["a"], "left").select("symbol", "ts", F.coalesce("rank", F.lit(0.5)).alias("global_rank"), (F.signum("x") * F.col("rank")).alias("signed_rank"))


# --- indicators that are frames ------------------------------------------------------------
_TR = f"CASE WHEN lag(close) OVER ({_S}) IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER ({_S})), abs(low - lag(close) OVER ({_S}))) END"


@query("ta01_to_ta32_frame_indicators", f"""WITH {HOURLY}, x AS (SELECT *, (high + low + close) / 3 AS tp, {_TR} AS trange, {_list('close', 10)} AS c10, {_list('high', 15)} AS h15, {_list('low', 15)} AS l15, sign(close - lag(close) OVER ({_S})) AS dir, CASE WHEN high > low THEN (2 * close - high - low) / (high - low) * volume ELSE 0 END AS mfv FROM bars),
y AS (SELECT *, {_full('avg(tp)', 'tp', 20)} AS tpm, {_list('tp', 20)} AS t20, {_full('max(high)', 'high', 14)} AS hh, {_full('min(low)', 'low', 14)} AS ll FROM x), z AS (SELECT *, CASE WHEN hh > ll THEN 100 * (close - ll) / (hh - ll) END AS fastk FROM y)
SELECT symbol, ts, {_full('avg(close)', 'close', 10)} AS sma, CASE WHEN len(c10) = 10 THEN list_sum(list_transform(c10, lambda v, i: v * i)) / 55 END AS wma, close - lag(close, 10) OVER ({_S}) AS mom, 100 * (close / lag(close, 10) OVER ({_S}) - 1) AS roc, CASE WHEN hh > ll THEN -100 * (hh - close) / (hh - ll) END AS willr,
CASE WHEN len(h15) = 15 THEN 100 * (len(h15) - list_position(list_reverse(h15), list_max(h15))) / 14.0 END AS aroon_up, CASE WHEN tpm IS NOT NULL AND list_avg(list_transform(t20, lambda v: abs(v - tpm))) > 0 THEN (tp - tpm) / (0.015 * list_avg(list_transform(t20, lambda v: abs(v - tpm)))) END AS cci,
trange, fastk, {_full('avg(fastk)', 'fastk', 3)} AS fastd, sum(coalesce(dir, 0) * volume) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS obv, sum(mfv) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS ad, {_full('avg(close)', 'close', 20)} + 2 * {_full('stddev_pop(close)', 'close', 20)} AS bb_upper FROM z""")
def _(spark, d):
    rows = views.hourly(spark, d)
    before = f.lag("close")
    tr = F.when(before.isNotNull(), F.greatest(b.h - b.l, F.abs(b.h - before), F.abs(b.l - before)))
    rows = rows.withColumns({"tp": (b.h + b.l + b.c) / 3, "trange": tr, "dir": F.signum(b.c - before), "mfv": F.when(b.h > b.l, (2 * b.c - b.h - b.l) / (b.h - b.l) * b.v).otherwise(0), "hh": f.max("high", 14), "ll": f.min("low", 14)})
    rows = rows.withColumns({"fastk": F.when(F.col("hh") > F.col("ll"), 100 * (b.c - F.col("ll")) / (F.col("hh") - F.col("ll"))), "tpm": f.mean("tp", 20), "t20": F.collect_list("tp").over(f.past(20)), "h15": F.collect_list("high").over(f.past(15))})
    dev = F.aggregate(F.transform("t20", lambda v: F.abs(v - F.col("tpm"))), F.lit(0.0), lambda a, x: a + x) / F.size("t20")
    aroon = F.when(F.size("h15") == 15, 100 * (F.size("h15") - F.array_position(F.reverse("h15"), F.array_max("h15"))) / 14)
    return rows.select(
        "symbol", "ts", f.mean("close", 10).alias("sma"), f.decay("close", 10).alias("wma"), f.delta("close", 10).alias("mom"), (100 * f.change("close", 10)).alias("roc"), F.when(F.col("hh") > F.col("ll"), -100 * (F.col("hh") - b.c) / (F.col("hh") - F.col("ll"))).alias("willr"), aroon.alias("aroon_up"),
        F.when(dev > 0, (F.col("tp") - F.col("tpm")) / (0.015 * dev)).alias("cci"), "trange", "fastk", f.mean("fastk", 3).alias("fastd"), F.sum(F.coalesce("dir", F.lit(0)) * b.v).over(f.so_far).alias("obv"), F.sum("mfv").over(f.so_far).alias("ad"), (f.mean("close", 20) + 2 * f.agg(F.stddev_pop, "close", 20)).alias("bb_upper"))


# --- sequential filters ----------------------------------------------------------------------
_REC = ("ema_20", "ewm_20", "tema", "trix", "kama", "rsi", "rsi_7", "rsi_21", "cmo", "atr", "atr_7", "atr_21", "natr", "ppo", "plus_di", "minus_di", "adx", "adxr", "adx_50", "plus_di_200", "minus_di_200", "macdfix", "macdfix_signal", "sar", "sar_ext", "adosc", "zigzag", "zz_high", "zz_low")


@query("ta02_to_ta33_recursive_indicators")
def _(spark, d):
    return recursive.with_indicators(views.hourly(spark, d)).select("symbol", "ts", *_REC)


@query("ta02_wn13_ema_seeded", f"""WITH RECURSIVE {HOURLY}, k AS (SELECT symbol, ts, close, row_number() OVER ({_S}) AS k, avg(close) OVER ({_S} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM bars),
e AS (SELECT symbol, ts, k, m AS ema FROM k WHERE k = 20 UNION ALL SELECT k.symbol, k.ts, k.k, e.ema + 2.0 / 21 * (k.close - e.ema) FROM e JOIN k ON k.symbol = e.symbol AND k.k = e.k + 1) SELECT k.symbol, k.ts, e.ema FROM k LEFT JOIN e USING (symbol, ts)""")
def _(spark, d):
    return recursive.with_indicators(views.hourly(spark, d)).select("symbol", "ts", F.col("ema_20").alias("ema"))


@query("fx117_xf20_dtw_templates")
def _(spark, d):
    """Distance of the last 20 closes to each shape, and the nearest one, for every bar; null before the 20th."""

    def run(pdf):
        found = filters.rolling(filters.warped_to_shapes, pdf["close"].to_numpy(float), filters.SHAPE_LENGTH, len(filters.SHAPES))
        names = np.array([*filters.SHAPES, None], object)
        best = names[np.where(np.isnan(found).any(1), len(filters.SHAPES), np.nan_to_num(found, nan=np.inf).argmin(1))]
        return pdf[["symbol", "ts"]].assign(**dict(zip(filters.SHAPES, found.T)), best=best)

    rows = views.hourly(spark, d).select("symbol", "ts", "close")
    return filters.overlapped(rows, ["symbol"], ["ts"], "symbol string, ts timestamp, " + ", ".join(f"{x} double" for x in filters.SHAPES) + ", best string", run, warm=filters.SHAPE_LENGTH)


_KNOWN = {"wick_upper": "open", "wick_lower": "open", "change_5": f"lag(close, 5) OVER ({_S})", "swing_high": f"lag(high, 4) OVER ({_S})", "range_volume": "open", "imbalance_range": "open"}
_ROWS = ", ".join(f"('{x.name}', '{x.category}', '{','.join(x.inputs)}')" for x in listed())


@query("ud01_ud02_catalog", f"""WITH {HOURLY}, k AS (SELECT {', '.join(f'{x} AS {n}' for n, x in _KNOWN.items())} FROM bars), c AS (SELECT unnest([{', '.join(f"{{'feature': '{n}', 'known': (SELECT count({n}) FROM k)}}" for n in _KNOWN)}], recursive := true)),
f(feature, category, inputs) AS (VALUES {_ROWS}) SELECT feature, category, inputs, known FROM f JOIN c USING (feature)""")
def _(spark, d):
    """The registered features with the number of bars on which each is known."""
    rows = views.hourly(spark, d)
    known = rows.select(*(x.build().alias(x.name) for x in listed())).agg(*(F.count(x.name).alias(x.name) for x in listed()))
    names = F.array(*(F.struct(F.lit(x.name).alias("feature"), F.lit(x.category).alias("category"), F.lit(",".join(x.inputs)).alias("inputs"), F.col(x.name).alias("known")) for x in listed()))
    return known.select(F.inline(names))
