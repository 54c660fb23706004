"""Envelopes, fractal and spectral columns, tails and volatility structure over hourly bars: rolling kernels in blocks with the bars that they look back at."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import filters, wavelets
from tidemark.operators.bars import BY_TIME as f
from tidemark.plans.register import query
from tidemark.plans.structure import LEVEL, SHORT, before, schema
from tidemark.sources import views


def _robust(x: np.ndarray, n: int, least: int = 10) -> np.ndarray:
    """Less the median of n and over their quartiles' distance; 0 where unknown."""
    s = pd.Series(x)
    r = s.rolling(n, min_periods=least)
    reach = r.quantile(0.75) - r.quantile(0.25)
    return ((s - r.median()) / (reach.where(reach != 0) + 1e-8)).fillna(0.0).to_numpy()


def fluctuation(x: np.ndarray, n: int = SHORT, level: int = LEVEL) -> np.ndarray:
    """What the trend leaves of the last value of the window that ended two rows ago; 0 before there is one. A constant added to x changes nothing."""
    last = wavelets.trend(n, level)[:, -1]
    return np.nan_to_num(before(filters.rolling(lambda rows: (rows[:, -1] - rows @ last)[:, None], x, n, 1)[:, 0], 2))


# --- envelopes ---------------------------------------------------------------------------------
_ENVELOPES = ("hilbert_price_env", "hilbert_cvd_env", "hilbert_cvd_price_env_ratio", "hilbert_price_env_slope", "hilbert_cvd_env_slope", "hilbert_price_env_qnorm", "hilbert_cvd_env_qnorm", "hilbert_volume_env", "hilbert_env_price_vol_ratio", "hilbert_triple_divergence")


def envelope_columns(typical: np.ndarray, delta: np.ndarray, volume: np.ndarray, row: int = 0, n: int = 64, span: int = 10, ranks: int = 252) -> dict[str, np.ndarray]:
    """Envelopes of price, signed volume and volume, as their rank in the last `ranks` bars, their ratios and changes, as of the bar before; NaN before there are any.

    An envelope is that of the n bars before a bar (volume: 32), smoothed with `span` (5).
    `row`: the place of the first bar in its history.
    """

    def env(x: np.ndarray, n: int, span: int) -> np.ndarray:
        raw = before(filters.rolling(filters.envelopes, x, n, 1)[:, 0])
        raw[: max(0, n - row)] = np.nan
        return filters.rank_in_window(pd.Series(raw).ewm(span=span, adjust=False).mean().to_numpy(), ranks, row=row)

    price, cvd = env(fluctuation(typical), n, span), env(fluctuation(np.cumsum(delta)), n, span)
    vol = env(volume - pd.Series(volume).rolling(20, min_periods=1).mean().to_numpy(), 32, 5)
    known = lambda x: np.nan_to_num(x) + 1e-8
    high = lambda x: pd.Series(x).rolling(20, min_periods=1).max().to_numpy()
    slope = lambda x: np.clip(np.diff(np.nan_to_num(x), prepend=np.nan), -1, 1)
    diverged = (price > before(high(price))) & (cvd < high(cvd)) & (vol < before(vol))
    out = [price, cvd, _robust(np.log(known(cvd) / known(price)), ranks), slope(price), slope(cvd), price, cvd, vol, _robust(np.log(known(price) / known(vol)), ranks), diverged.astype(float)]
    return {k: before(x) for k, x in zip(_ENVELOPES, out)}


@query("fx063_hilbert_envelopes")
def _(spark, d):
    """Smoothed envelopes of wavelet fluctuations; the smoothing's weight on bars before the block's warm rows is below 1e-80."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        high, low, close, volume, delta = (pdf[x].to_numpy(float) for x in ("high", "low", "close", "volume", "delta"))
        return pdf[["symbol", "ts"]].assign(**envelope_columns((high + low + close) / 3, delta, volume, int(pdf["_n"].iloc[0])))

    rows = views.hourly(spark, d).select("symbol", "ts", "high", "low", "close", "volume", (F.col("buy_qty") - F.col("sell_qty")).alias("delta"))
    return filters.overlapped(rows, ["symbol"], ["ts"], schema(_ENVELOPES), run, warm=1_500)


# --- Hurst exponents and spectra ------------------------------------------------------------------
_SPECTRUM = ("has_dominant_freq", "flatness", "high_freq_ratio", "low_freq_ratio", "entropy", "centroid")
#: What a price's spectrum is before its first window; the others are unknown there.
_NO_SPECTRUM = (0.0, 1.0, 0.0, 0.0, 1.0, 0.0)


def return_clip(bars: DataFrame) -> DataFrame:
    """symbol, clip: how far returns count, by how much a symbol's closes vary over its whole history (it looks ahead, as the definition does)."""
    r = bars.select("symbol", "ts", f.change("close").alias("r")).where("r IS NOT NULL")
    r = r.withColumn("sd", f.std("r", 100, 10))
    a = r.groupBy("symbol").agg(F.avg("sd").alias("sd"), F.max(F.abs("r")).alias("top"), F.avg((F.abs("r") > 0.1).cast("int")).alias("far"), F.count("*").alias("n"))
    return a.select("symbol", F.when(F.col("n") < 20, 0.5).when(F.col("sd") > 0.03, F.when((F.col("top") > 0.5) | (F.col("far") > 0.05), 1.0).otherwise(0.8)).when(F.col("sd") > 0.01, F.when((F.col("top") > 0.3) | (F.col("far") > 0.02), 0.7).otherwise(0.5)).otherwise(0.3).alias("clip"))


def fractal_columns(close: np.ndarray, delta: np.ndarray, volume: np.ndarray, clip: float, row: int = 0, n: int = 50, window: int = 64) -> dict[str, np.ndarray]:
    """Hurst exponents of the n increments that ended two bars ago, and the spectrum of the `window` increments before each bar (its centroid as a rank in 252 bars)."""
    change = lambda x: np.concatenate([[np.nan], x[1:] / x[:-1] - 1])
    delta = delta.astype(float).copy()
    out = {}
    with np.errstate(all="ignore"):
        returns, grown = change(close), change(volume)
    first = np.where(np.arange(len(close)) + row == 0, np.nan, delta)  # the first change is unknown
    for name, x in (("price", np.clip(returns, -clip, clip)), ("cvd", first), ("volume", np.clip(grown, -clip, clip))):
        out[f"hurst_{name}_rolling"] = before(filters.rolling(filters.hursts, np.where(np.isfinite(x), x, np.nan), n, 1)[:, 0], 2)
    for name, x in (("price", np.nan_to_num(returns)), ("volume", np.diff(volume, prepend=volume[:1])), ("cvd", np.where(np.isnan(first), 0, delta))):
        found = filters.rolling(filters.spectra, x, window, len(_SPECTRUM))
        found = np.stack([before(found[:, k]) for k in range(len(_SPECTRUM))], 1)
        found[: max(0, window - row)] = _NO_SPECTRUM if name == "price" else np.nan
        found[:, 5] = filters.rank_in_window(found[:, 5], row=row)
        out |= {f"spectrum_{name}_{part}": found[:, k] for k, part in enumerate(_SPECTRUM) if k or name == "price"}
    return out


@query("fx064_fx161_to_fx164_hurst_spectrum")
def _(spark, d):
    """Exponents and spectra of price, signed volume and volume."""
    names = [f"hurst_{x}_rolling" for x in ("price", "cvd", "volume")] + [f"spectrum_{x}_{p}" for x in ("price", "volume", "cvd") for k, p in enumerate(_SPECTRUM) if k or x == "price"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        close, delta, volume = (pdf[x].to_numpy(float) for x in ("close", "delta", "volume"))
        return pdf[["symbol", "ts"]].assign(**fractal_columns(close, delta, volume, pdf["clip"].iloc[0], int(pdf["_n"].iloc[0])))

    bars = views.hourly(spark, d)
    clip = return_clip(bars)
    rows = bars.select("symbol", "ts", "close", "volume", (F.col("buy_qty") - F.col("sell_qty")).alias("delta")).join(clip, "symbol", "left")
    return filters.overlapped(rows.fillna(0.5, ["clip"]), ["symbol"], ["ts"], schema(names), run, warm=64 + 252 + 5)


# --- tails ----------------------------------------------------------------------------------------
_TAIL = ("tail_shape", "scale", "var_99", "es_99")
#: What an estimate is before the first one.
_NO_TAIL = {"left": (0.3, 0.001, -0.01, -0.01), "right": (0.3, 0.001, 0.01, 0.01)}


def tail_columns(close: np.ndarray, row: int = 0, n: int = 120, least: int = 10) -> dict[str, np.ndarray]:
    """Tail estimates of the n returns before each bar, the last known where there is none, shapes smoothed over n, all as ranks in 252 bars."""
    with np.errstate(all="ignore"):
        returns = np.concatenate([[np.nan], close[1:] / close[:-1] - 1])
    found = filters.rolling(lambda rows: filters.tails(rows, least=least), returns, n, 8)
    out = {}
    for k in range(8):
        side, part = ("left", "right")[k // 4], _TAIL[k % 4]
        x = pd.Series(before(found[:, k])).ffill()
        if part == "tail_shape":
            x = x.ewm(span=max(20, min(120, n)), adjust=False).mean()
        rank = filters.rank_in_window(x.fillna(_NO_TAIL[side][k % 4]).to_numpy(), row=row)
        out[f"evt_{part}_{side}"] = np.where(np.isnan(rank), 0.5, rank)
    return out | {f"evt_{part}": out[f"evt_{part}_left"] for part in _TAIL}


@query("fx119_fx138_tails")
def _(spark, d):
    """Extreme-value columns and their product with the trend's R2; what the smoothing and the last known estimates owe to bars over 4000 back is below 1e-25."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = tail_columns(pdf["close"].to_numpy(float), int(pdf["_n"].iloc[0]))
        return pdf[["symbol", "ts"]].assign(**out, evt_x_trend_r2=out["evt_tail_shape"] * pdf["r2"].fillna(0.0).to_numpy())

    bars = views.hourly(spark, d).withColumn("clock", F.row_number().over(f.ordered).cast("double"))
    r2 = F.when(F.col("clock") >= 3, F.regr_r2(F.log("close"), F.col("clock")).over(f.past(20)))
    names = [f"evt_{x}{side}" for side in ("_left", "_right", "") for x in _TAIL] + ["evt_x_trend_r2"]
    return filters.overlapped(bars.select("symbol", "ts", "close", r2.alias("r2")), ["symbol"], ["ts"], schema(names), run, warm=4_000)


# --- volatility structure -------------------------------------------------------------------------
@query("fx116_xf18_volatility_structure")
def _(spark, d):
    """Autocorrelation of absolute returns, how much more variance follows a fall than a rise, and whether large moves follow large ones: 0 to 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["symbol", "ts"]].assign(**volatility_columns(pdf["close"]))

    return filters.overlapped(views.hourly(spark, d).select("symbol", "ts", "close"), ["symbol"], ["ts"], schema(("vol_persistence", "vol_leverage_asymmetry", "vol_clustering_strength")), run, warm=1_000)


def volatility_columns(close: pd.Series, span: int = 20, long: int = 100, short: int = 60) -> dict[str, pd.Series]:
    r = close.pct_change().fillna(0.0)
    size = r.abs()
    corr = lambda x, n, least: x.rolling(n, min_periods=least).corr(x.shift(1)).fillna(0.0).clip(0.0, 1.0)
    after = lambda sign: (r**2 * (sign * r.shift(1) > 0)).ewm(span=span, min_periods=5).mean()
    falls, rises = after(-1), after(1)
    share = (falls / (falls + rises).where(falls + rises != 0)).fillna(0.5).clip(0.0, 1.0)
    big = (size > size.rolling(short, min_periods=20).median()).astype(float)
    return {
        "vol_persistence": corr(size, long, 30).ewm(span=5, min_periods=2).mean(),
        "vol_leverage_asymmetry": (2 * share - 1).clip(0.0, 1.0).rolling(short, min_periods=20).mean().fillna(0.0),
        "vol_clustering_strength": corr(big, short, 20),
    }


# --- energy of price and volume together ------------------------------------------------------------
_ENERGY = ("wpt_vper_low", "wpt_vper_mid", "wpt_vper_high", "wpt_energy_cascade", "wpt_multi_scale_consistency", "wpt_breakout_confidence", "wpt_false_breakout_risk")


def energy_columns(close: np.ndarray, volume: np.ndarray, row: int = 0, n: int = 20, level: int = LEVEL) -> dict[str, np.ndarray]:
    """Volume's energy over price's by band, in the n returns and n + 1 volumes up to each bar, and what they say of a breakout; 0 before there are n.

    Bands by the share of low halves in a packet's path: all but none of them (low), up to half (mid), more (high).
    """
    paths = sorted(wavelets.packets(n, level))
    lows = np.array([p.count("a") / level for p in paths])
    band = {"low": lows < 0.25, "mid": (lows >= 0.25) & (lows < 0.75), "high": lows >= 0.75}
    per_path = lambda rows: np.stack([wavelets.energies(rows, level)[p] for p in paths], 1)
    returns = np.diff(np.log(close), prepend=np.nan)
    price, vol = filters.rolling(per_path, returns, n, len(paths)), filters.rolling(per_path, volume, n + 1, len(paths))
    earlier = np.vstack([np.full((1, len(paths)), np.nan), price[:-1]])
    if row == 0 and len(close) > n:  # the bar before the first full window has one return less
        earlier[n] = per_path(returns[None, 1:n])[0]
    e, v = ({k: x[:, m].sum(1) for k, m in band.items()} for x in (price, vol))
    eps = 1e-8
    ratio = {k: v[k] / (e[k] + eps) for k in band}
    total = e["low"] + e["mid"] + e["high"]
    with np.errstate(all="ignore"):
        cascade = np.where(total > 0, (e["low"] + e["mid"] - e["high"]) / total, np.where(np.isnan(total), np.nan, 0.0))
        up = (earlier > 0) & ((price - earlier) / earlier > 0.1)
    steady = up[:, band["mid"]].sum(1) / max(int(band["mid"].sum()), 1)
    mid = np.nan_to_num(ratio["mid"])
    place = np.full(len(close), 0.5)
    if len(close) > 2 * n:
        w = np.lib.stride_tricks.sliding_window_view(mid, n + 1)
        past, now = w[:, :-1], w[:, -1:]
        below, upto = (past < now).sum(1), (past <= now).sum(1)
        place[n:] = np.where(np.arange(n, len(close)) + row >= 2 * n, (below + upto + (upto > below)) * 0.5 / n, 0.5)
    sure = np.clip((cascade + 1) / 2 * 0.4 + place * 0.3 + steady * 0.3, 0, 1)
    risk = np.where((e["high"] > 2 * e["mid"]) & (ratio["mid"] < 0.5), np.minimum(sure + 0.3, 1), 1 - sure)
    out = [ratio["low"], ratio["mid"], ratio["high"], cascade, np.where(np.isnan(total), np.nan, steady), sure, risk]
    return dict(zip(_ENERGY, map(np.nan_to_num, out)))


@query("fx050_wavelet_energies")
def _(spark, d):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["symbol", "ts"]].assign(**energy_columns(pdf["close"].to_numpy(float), pdf["volume"].to_numpy(float), int(pdf["_n"].iloc[0])))

    return filters.overlapped(views.hourly(spark, d).select("symbol", "ts", "close", "volume"), ["symbol"], ["ts"], schema(_ENERGY), run, warm=60)
