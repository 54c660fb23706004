"""Divergence, exhaustion and participation scores: ranks of price, signed volume and speed in their own past."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import filters
from tidemark.operators.bars import BY_TIME as f
from tidemark.plans.register import query
from tidemark.plans.structure import schema
from tidemark.sources import views


def place(x: np.ndarray, n: int, row: int = 0) -> np.ndarray:
    """Share of the last n values before the current one (0 the least, 1 the greatest) that are at most it; NaN under a third of n known ones. `row`: the place of x[0] in its history."""
    size = np.minimum(np.arange(len(x)) + row + 1, n)
    with np.errstate(all="ignore"):
        return (np.rint(filters.rank_in_window(x, n, max(10, n // 3), row) * size) - 1) / (size - 1)  # whole counts: equal places are equal numbers


def _smooth(x: np.ndarray, span: int) -> np.ndarray:
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def _step(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.nan)


_or_half = lambda x: np.where(np.isnan(x), 0.5, x)


def _apart(a: np.ndarray, b: np.ndarray, trend: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a - b (0 where unknown), its tension with the trend, and its weight at the ends of b's range."""
    d = np.clip(np.nan_to_num(a - b), -1, 1)
    return d, np.sqrt(np.abs(d) * np.abs(trend)), np.clip(np.abs(d) * np.abs(_or_half(b) - 0.5) * 2, 0, 1)


def divergence_columns(close: np.ndarray, flow: np.ndarray, volume: np.ndarray, trend: np.ndarray, row: int = 0, near: int = 50, fast: int = 30, far: int = 540) -> dict[str, np.ndarray]:
    """Columns of a symbol's bars in order of time.

    Price, signed volume (`flow`) and speed by their place in `near` (speed: `fast`) bars,
    the differences by theirs in `far`; exhaustion where speed and its change are low and
    flow does not support an extreme price; participation by volume, its change and 5 bars over 20.
    """
    trend = np.clip(np.nan_to_num(trend), -1, 1)
    speed = _smooth(_step(close), 6)
    haste = _smooth(_step(speed), 4)
    at = place(close, near, row)
    flow_apart, flow_tension, flow_pressure = _apart(place(flow, near, row), at, trend)
    speed_apart, speed_tension, speed_pressure = _apart(place(speed, fast, row), at, trend)
    speed_at, haste_at = _or_half(place(speed, far, row)), _or_half(place(haste, far, row))
    end = np.clip(np.abs(_or_half(at) - 0.5) * 2, 0, 1)
    tired, unbacked = (1 - speed_at) * (1 - haste_at), np.abs(flow_apart) * flow_pressure
    active, moving = _or_half(place(volume, far, row)), _or_half(place(_smooth(_step(volume), 5), far, row))
    mean = lambda n: pd.Series(volume).rolling(n).mean().to_numpy()
    steady = _or_half(np.clip(mean(5) / (mean(20) + 1e-8), 0, 2) / 2)
    return {
        "cvd_divergence_score": flow_apart, "cvd_divergence_score_pct": _or_half(place(flow_apart, far, row)), "price_position": _or_half(at), "trend_div_alignment": np.clip(flow_apart * trend, -1, 1), "trend_div_tension": flow_tension, "div_location_pressure": flow_pressure,
        "price_velocity_pct": speed_at, "price_accel_pct": haste_at, "price_momentum_div_score": speed_apart, "price_momentum_div_score_pct": _or_half(place(speed_apart, far, row)), "momentum_div_tension": speed_tension, "momentum_location_pressure": speed_pressure,
        "momentum_exhaustion_score": np.clip(tired, 0, 1), "cvd_exhaustion_score": np.clip(unbacked, 0, 1), "location_amplifier": end, "terminal_risk_score": np.clip(tired * unbacked * end, 0, 1),
        "volume_activity_pct": active, "volume_velocity_pct": moving, "volume_stability": steady, "volume_participation_score": np.clip(active * np.sqrt(np.abs(moving)) * steady, 0, 1),
    }


NAMES = tuple(divergence_columns(*(np.arange(3.0),) * 4))


@query("fx132_to_fx135_divergence")
def _(spark, d):
    """Divergence of price from signed volume and from its own speed, terminal risk and participation; what smoothing owes to bars over 1400 back is below 1e-80."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = divergence_columns(*(pdf[x].to_numpy(float) for x in ("close", "flow", "volume", "r2")), int(pdf["_n"].iloc[0]))
        return pdf[["symbol", "ts"]].assign(**found)

    bars = views.hourly(spark, d).withColumn("clock", F.row_number().over(f.ordered).cast("double"))
    r2 = F.when(F.col("clock") >= 3, F.regr_r2(F.log("close"), F.col("clock")).over(f.past(20)))
    rows = bars.select("symbol", "ts", "close", "volume", f.sum(F.col("buy_qty") - F.col("sell_qty"), 288, 1).alias("flow"), r2.alias("r2"))
    return filters.overlapped(rows, ["symbol"], ["ts"], schema(NAMES), run, warm=1_400)
