"""Wavelet, value-profile and level columns over hourly bars: rolling kernels, each over the bars before the current one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import filters, profiles, recursive, wavelets
from tidemark.operators.bars import BY_TIME as f
from tidemark.plans.register import query
from tidemark.sources import views

#: Bars in a window, and splits of a packet transform.
SHORT, LONG, LEVEL = 100, 160, 4


def schema(names) -> str:
    return "symbol string, ts timestamp, " + ", ".join(f"{x} double" for x in names)


def before(x: np.ndarray, n: int = 1) -> np.ndarray:
    """Values as they were n rows earlier."""
    out = np.full_like(x, np.nan, dtype=float)
    out[n:] = x[: len(x) - n] if n else x
    return out


def _log_robust(x: np.ndarray, n: int = 50, least: int = 10) -> np.ndarray:
    """log(1 + |x|), less the median of n and over their quartiles' distance; 0 where unknown."""
    s = pd.Series(np.log1p(np.abs(np.nan_to_num(x)))).rolling(n, min_periods=least)
    reach = s.quantile(0.75) - s.quantile(0.25)
    return ((s.apply(lambda v: v[-1], raw=True) - s.median()) / (reach.where(reach != 0) + 1e-8)).fillna(0.0).to_numpy()


def energy_columns(typical: np.ndarray, volume: np.ndarray, n: int = SHORT, level: int = LEVEL) -> dict[str, np.ndarray]:
    """Of the window that ended two bars ago: trend and fluctuation of its last price, and shares of energy by band; 0 before there is one.

    `level` counts where the window is long enough: else a band of that name does not exist, and its share is 0.
    """

    def of_price(rows: np.ndarray) -> np.ndarray:
        energy = wavelets.energies(rows, wavelets.depth(rows.shape[1], level))
        low, mid, high = wavelets.bands(energy)
        total, last = sum(energy.values()), rows @ wavelets.trend(rows.shape[1], level)[:, -1]
        with np.errstate(all="ignore"):
            shares = [np.where(total > 0, x / total, np.nan) for x in (low, mid, high)]
            return np.stack([last, rows[:, -1] - last, rows[:, -1], *shares, np.where(low > 0, mid / low, np.nan), total], 1)

    def of_volume(rows: np.ndarray) -> np.ndarray:
        energy = wavelets.energies(rows, wavelets.depth(rows.shape[1], level))
        total = sum(energy.values())
        with np.errstate(all="ignore"):
            return np.stack([np.where(total > 0, energy.get("a" * level, 0.0) / total, np.nan), total], 1)

    names = ("trend", "fluctuation", "reconstructed", "low", "mid", "high", "mid_low", "energy")
    out = dict(zip(names, filters.rolling(of_price, typical, n, len(names)).T))
    share, energy = filters.rolling(of_volume, volume, n, 2).T
    with np.errstate(all="ignore"):
        out |= {"volume_low": share, "vper": np.where((energy > 0) & (out["energy"] > 0), energy / out["energy"], np.nan)}
    del out["energy"]
    returns = filters.rolling(of_price, np.diff(np.log(np.maximum(typical, 1e-10)), prepend=np.nan), n - 1, len(names)).T
    out |= {f"r_{k}": x for k, x in zip(names[:-1], returns)}
    return {k: np.nan_to_num(before(x, 2)) for k, x in out.items()}


_WAVELETS = ("wpt_price_trend", "wpt_price_fluctuation", "wpt_price_reconstructed", "wpt_price_energy_low_ratio", "wpt_price_energy_mid_ratio", "wpt_price_energy_high_ratio", "wpt_price_energy_mid_low_ratio")
_OF_RETURNS = ("wpt_return_trend", "wpt_return_fluctuation", "wpt_return_energy_low_ratio", "wpt_return_energy_mid_ratio", "wpt_return_energy_high_ratio")
_NORMALIZED = ("wpt_price_trend_n", "wpt_price_fluctuation_n", "wpt_price_reconstructed_n", "wpt_mid_low_robust", "wpt_volume_energy_low_ratio", "wpt_vper")


def with_wavelets(bars: DataFrame) -> DataFrame:
    """symbol, ts and the wavelet columns of bars: raw, over the close, and of log returns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        close = pdf["close"].to_numpy(float)
        x = energy_columns((pdf["high"].to_numpy(float) + pdf["low"].to_numpy(float) + close) / 3, pdf["volume"].to_numpy(float))
        out = dict(zip(_WAVELETS, (x[k] for k in ("trend", "fluctuation", "reconstructed", "low", "mid", "high", "mid_low"))))
        out |= {"wpt_return_trend": x["r_trend"] / close - 1, "wpt_return_fluctuation": x["r_fluctuation"] / close}
        out |= {f"wpt_return_energy_{k}_ratio": x[f"r_{k}"] for k in ("low", "mid", "high")}
        out |= {"wpt_price_trend_n": x["trend"] / close - 1, "wpt_price_fluctuation_n": x["fluctuation"] / close, "wpt_price_reconstructed_n": x["reconstructed"] / close - 1}
        out |= {"wpt_mid_low_robust": _log_robust(x["mid_low"]), "wpt_volume_energy_low_ratio": x["volume_low"], "wpt_vper": _log_robust(x["vper"])}
        return pdf[["symbol", "ts"]].assign(**out)

    rows = bars.select("symbol", "ts", "high", "low", "close", "volume")
    return filters.overlapped(rows, ["symbol"], ["ts"], schema([*_WAVELETS, *_OF_RETURNS, *_NORMALIZED]), run, warm=SHORT + 60)


@query("fx037_fx038_fx046_xf21_wavelets")
def _(spark, d):
    """Wavelet packet trend, fluctuation and energy shares of the windows before each bar."""
    return with_wavelets(views.hourly(spark, d))


# --- value profiles --------------------------------------------------------------------------
def profile_columns(price: np.ndarray, volume: np.ndarray, n: int, bins: int | None = None, level: int = LEVEL) -> dict[str, np.ndarray]:
    """Columns of the profile of the n bars before each bar, whose prices have lost their highest bands; NaN where there is none."""
    names = ("poc", "poc_volume_ratio", "hal_high", "hal_low", "hal_mid", "hvn_count", "lvn_count", "lvn_distance", "volume_density", "price_in_lvn", "boundary_stability", "width_ratio", "poc_deviation", "skewness", "entropy", "lv_ratio", "hv_ratio")
    out = {k: np.full(len(price), np.nan) for k in names}
    if len(price) <= n:
        return out
    soft = wavelets.smooth(n, level)
    p, v = (np.lib.stride_tricks.sliding_window_view(x, n)[:-1] for x in (price, volume))
    for at in range(0, len(p), 2048):
        raw, vol, now = p[at : at + 2048], v[at : at + 2048], price[n + at : n + at + 2048]
        one = profiles.profiles(raw @ soft, vol, bins)
        peak, down, up = profiles.value_area(one)
        width = (one.high - one.low) / (one.bins if bins is None else bins)
        with np.errstate(all="ignore"):
            found = {"poc": one.centre(peak), "poc_volume_ratio": one.hist.max(1) / one.hist.sum(1), "hal_high": one.edge(up + 1), "hal_low": one.edge(down)}
        found["hal_mid"] = (found["hal_high"] + found["hal_low"]) / 2
        found |= profiles.nodes(one, now, width) | profiles.shape(one, now)
        found["boundary_stability"] = profiles.agreement(profiles.profiles(raw, vol, bins), one)
        for k, x in found.items():
            out[k][n + at : n + at + len(raw)] = np.where(one.known, x, np.nan)
    return out


_UNIFIED = ("vp_poc", "vp_poc_volume_ratio", "vp_hal_high", "vp_hal_low", "vp_hal_mid", "vp_hvn_count", "vp_lvn_count", "vp_lvn_distance", "vp_volume_density", "vp_price_in_lvn", "vp_boundary_stability_score")
_VISIBLE = ("vpvr_pvp", "vpvr_hvn_count", "vpvr_lvn_count", "vpvr_lvn_distance", "vpvr_volume_density", "vpvr_price_in_lvn")
_SHAPE = ("vp_width_ratio", "vp_poc_deviation", "vp_skewness", "vp_entropy", "vp_lv_ratio", "vp_hv_ratio")
_WAVED = ("wpt_poc", "wpt_hal_high", "wpt_hal_low", "wpt_hal_mid")


def with_profiles(bars: DataFrame) -> DataFrame:
    """bars with value-profile columns: of 160 closes, of 100 typical prices in 50 bins, of 100 closes, and of 160 rebuilt prices (wpt_).

    Prices stay the last known ones where a window has no range; counts and shares are 0 there, shapes the last known.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        close, high, low, volume = (pdf[x].to_numpy(float) for x in ("close", "high", "low", "volume"))
        typical = (high + low + close) / 3
        unified = profile_columns(close, volume, LONG)
        out = {k: unified[k.removeprefix("vp_").removesuffix("_score")] for k in _UNIFIED}
        visible = profile_columns(typical, volume, SHORT, bins=50)
        out |= {k: visible["poc" if k == "vpvr_pvp" else k.removeprefix("vpvr_")] for k in _VISIBLE}
        form = profile_columns(close, volume, SHORT)
        out |= {k: form[k.removeprefix("vp_")] for k in _SHAPE}
        waved = profile_columns(np.nan_to_num(before(typical, 2)) * (np.arange(len(close)) + first_row(pdf) > SHORT), volume, LONG)
        out |= {k: waved[k.removeprefix("wpt_")] for k in _WAVED}
        return pdf[["symbol", "ts"]].assign(**out)

    names = [*_UNIFIED, *_VISIBLE, *_SHAPE, *_WAVED]
    rows = bars.select("symbol", "ts", "high", "low", "close", "volume")
    found = filters.overlapped(rows, ["symbol"], ["ts"], schema(names), run, warm=LONG + 5)
    carried = ("vp_poc", "vp_hal_high", "vp_hal_low", "vp_hal_mid", "vp_boundary_stability_score", "vpvr_pvp", *_SHAPE, *_WAVED)
    # NaN and null are one to a frame that carries values on
    found = found.withColumns({k: F.nanvl(k, F.lit(None).cast("double")) for k in names})
    found = found.withColumns({k: f.filled(k) for k in carried})
    zero = [k for k in names if k not in ("vp_poc", "vp_poc_volume_ratio", "vp_hal_high", "vp_hal_low", "vp_hal_mid", *_WAVED)]
    return bars.join(found.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in zero}), ["symbol", "ts"])


def first_row(pdf: pd.DataFrame) -> int:
    return int(pdf["_n"].iloc[0])


@query("fx039_fx047_fx048_fx053_value_profiles")
def _(spark, d):
    """Points of control, value areas, nodes and shapes of the profiles before each bar."""
    return with_profiles(views.hourly(spark, d)).select("symbol", "ts", *_UNIFIED, *_VISIBLE, *_SHAPE, *_WAVED)


# --- levels ------------------------------------------------------------------------------------
#: Bars in which a level's touches are looked for.
TOUCHES = 60


def level_columns(high, low, close, volume, atr, poc, hal_high, hal_low, row: np.ndarray, n: int = TOUCHES, tolerance: float = 0.5, near: float = 0.15) -> dict[str, np.ndarray]:
    """Quality of the value area's ends over the n bars up to this one, and the strength and distance of all three levels as of the bar before.

    Arrays in order of time; `row` counts a symbol's bars from 0. Strengths take the n bars
    before the bar, do not ask for volume, and gain `near` for each other level within
    `tolerance` ATR; the point of control is taken as support and resistance, weighted by
    where the price is and goes. Before there are n bars, qualities and distances are 0.
    """
    size = len(close)
    atr = np.nan_to_num(atr)
    zero = lambda: np.zeros(size)
    out = {k: zero() for k in ("sqs_hal_high", "sqs_hal_low", "strength", "dist", "side")}
    out["strength"][:] = 0.5
    if size <= n:
        return out
    windows = {k: np.lib.stride_tricks.sliding_window_view(x, n) for k, x in (("high", high), ("low", low), ("close", close), ("volume", volume))}
    for at in range(n, size, 4096):
        i = np.arange(at, min(size, at + 4096))
        incl, excl = ({k: x[i - n + shift] for k, x in windows.items()} for shift in (1, 0))
        early = row[i] < n
        for name, level, support in (("sqs_hal_high", hal_high, False), ("sqs_hal_low", hal_low, True)):
            found = profiles.level_quality(level[i], incl["high"], incl["low"], incl["close"], atr[i], incl["volume"], support, tolerance)
            out[name][i] = np.where(early | ~(level[i] > 0), 0.0, found)
        held = lambda level, support: profiles.level_quality(level[i], excl["high"], excl["low"], excl["close"], atr[i - 1], None, support, tolerance)  # noqa: B023, E731
        levels = {"high": hal_high[i], "low": hal_low[i], "poc": poc[i]}
        bonus = {k: 1 + near * sum(np.abs(x - y) <= atr[i] * tolerance for other, y in levels.items() if other != k) for k, x in levels.items()}
        support, resistance = held(poc, True), held(poc, False)
        above, drift = close[i] > poc[i], close[i - 1] - close[i - 3]
        weight = np.where(above & (drift < 0), 0.7, np.where(~above & (drift > 0), 0.3, 0.5))
        mixed = (support * weight + resistance * (1 - weight)) * bonus["poc"]
        parts = [held(hal_high, False) * bonus["high"], held(hal_low, True) * bonus["low"], mixed, support, resistance, above, drift < 0, weight, 1 - weight]
        out["strength"][i] = np.where(early, 0.5, np.max(np.stack([np.asarray(x, float) for x in parts]), 0))
    every = np.stack([hal_high, hal_low, poc])
    nearest = every[np.abs(every - close).argmin(0), np.arange(size)]
    gap = np.where(close > 0, (close - nearest) / np.where(close > 0, close, 1), 0.0)
    out["dist"] = np.nan_to_num(before(gap)) * close / np.where(atr == 0, 1e-8, atr)
    out["side"] = np.nan_to_num(before(np.where(close < nearest, 1.0, -1.0)))
    out["strength"] = np.where(np.isnan(before(out["strength"])), 0.5, before(out["strength"]))
    return out


def _share_before(x: np.ndarray, n: int = 540) -> np.ndarray:
    """Share of the n - 1 values before that are at most the current one, as it was one row ago."""
    return before(filters.rolling(lambda rows: (rows[:, :-1] <= rows[:, -1:]).mean(1, keepdims=True), x, n, 1)[:, 0])


_LEVELS = ("poc", "hal_high", "hal_low", "hal_mid", "sqs_hal_high", "sqs_hal_low", "sqs_hal_high_pct", "sqs_hal_low_pct", "sr_strength_combined", "sr_strength_max", "dist_to_nearest_sr", "direction_to_nearest_sr")


def with_levels(rows: DataFrame) -> DataFrame:
    """symbol, ts and the levels of the profile in ATR from the close, their quality, its percentile, and the nearest one.

    rows: bars with atr and the columns of with_profiles.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        high, low, close, volume, atr = (pdf[x].to_numpy(float) for x in ("high", "low", "close", "volume", "atr"))
        scale = np.where(np.isnan(atr) | (atr == 0), 1e-8, atr) + 1e-8
        out = {k: np.nan_to_num((pdf[f"vp_{k}"].to_numpy(float) - close) / scale) for k in ("poc", "hal_high", "hal_low", "hal_mid")}
        priced = {k: x * np.nan_to_num(atr) + close for k, x in out.items()}
        found = level_columns(high, low, close, volume, atr, priced["poc"], priced["hal_high"], priced["hal_low"], pdf["_n"].to_numpy())
        out |= {"sqs_hal_high": found["sqs_hal_high"], "sqs_hal_low": found["sqs_hal_low"]}
        out |= {f"{k}_pct": _share_before(found[k]) for k in ("sqs_hal_high", "sqs_hal_low")}
        out["sr_strength_combined"] = np.maximum(found["sqs_hal_high"], found["sqs_hal_low"])
        out |= {"sr_strength_max": found["strength"], "dist_to_nearest_sr": found["dist"], "direction_to_nearest_sr": found["side"]}
        return pdf[["symbol", "ts"]].assign(**out)

    rows = rows.select("symbol", "ts", "high", "low", "close", "volume", "atr", "vp_poc", "vp_hal_high", "vp_hal_low", "vp_hal_mid")
    return filters.overlapped(rows, ["symbol"], ["ts"], schema(_LEVELS), run, warm=540 + TOUCHES + 5)


@query("fx039_to_fx044_fx149_xf10_levels")
def _(spark, d):
    """Value-area levels in ATR, how well they have held, their strength and the nearest one."""
    return with_levels(with_profiles(recursive.with_indicators(views.hourly(spark, d))))
