"""Rolling kernels in numpy, and the grouped map that runs them over long histories in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapped(rows: DataFrame, keys: list[str], order: list[str], schema: str, f: Callable[[pd.DataFrame], pd.DataFrame], block: int = 100_000, warm: int = 2_000) -> DataFrame:
    """f over each key's ordered rows in blocks of `block` rows, each with the `warm` rows before it.

    A group never holds more than block + warm rows. For a kernel that looks at no more
    than `warm` rows back the result is that of one pass over everything; filters with a
    longer memory belong in `recursive`. f gets and returns a frame of the same length.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    n = rows.withColumn("_n", F.row_number().over(w) - 1)
    own, head = F.floor(F.col("_n") / block), F.floor((F.col("_n") + warm) / block)
    dealt = n.withColumn("_block", F.explode(F.sequence(own, head)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        inside = (pdf["_n"] // block == pdf["_block"]).to_numpy()
        return f(pdf)[inside]

    return dealt.groupBy(*keys, "_block").applyInPandas(run, schema)


def rolling(kernel: Callable[[np.ndarray], np.ndarray], x: np.ndarray, n: int, width: int) -> np.ndarray:
    """kernel (rows of n values to rows of `width`) at every place of x; NaN before the n-th value and where the window has a NaN."""
    out = np.full((len(x), width), np.nan)
    if len(x) >= n:
        windows = np.lib.stride_tricks.sliding_window_view(x, n)
        for at in range(0, len(windows), 4096):
            part = windows[at : at + 4096]
            known = ~np.isnan(part).any(1)
            out[n - 1 + at : n - 1 + at + len(part)][known] = kernel(part[known])
    return out


def hursts(rows: np.ndarray, smallest: int = 4, scales: int = 8, largest: int = 100) -> np.ndarray:
    """Of each row of increments the slope of log fluctuation on log scale, 0 to 1.

    Scales lie evenly in logs from `smallest` to a quarter of the row (`largest` at most);
    the fluctuation at a scale is the mean over segments of the deviation from a segment's
    own line. NaN for a row of zeros, and where fewer than three scales fit.
    """
    n = rows.shape[1]
    most = min(n // 4, largest)
    if n < 20 or most < smallest:
        return np.full((len(rows), 1), np.nan)
    y = np.cumsum(rows - rows.mean(1, keepdims=True), 1)
    found = []
    for s in np.unique(np.logspace(np.log10(smallest), np.log10(most), scales).astype(int)):
        k = n // s
        if s >= smallest and k >= 2:
            seg = y[:, : k * s].reshape(-1, k, s)
            t = np.arange(s) - (s - 1) / 2
            line = (seg * t).sum(2, keepdims=True) / (t**2).sum() * t + seg.mean(2, keepdims=True)
            found.append((np.log(s), np.log(np.maximum(np.sqrt(((seg - line) ** 2).mean(2)).mean(1), 1e-9))))
    if len(found) < 3:
        return np.full((len(rows), 1), np.nan)
    a, b = np.array([x for x, _ in found]), np.stack([x for _, x in found], 1)
    slope = ((a - a.mean()) * (b - b.mean(1, keepdims=True))).sum(1) / ((a - a.mean()) ** 2).sum()
    return np.where((np.abs(rows) <= 1e-8).all(1), np.nan, np.clip(slope, 0, 1))[:, None]


def power(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (per row step) and Welch's power density of each row: half-overlapping Hann segments of half the row (8 to 64), each less its mean."""
    n = rows.shape[1]
    size = min(max(8, n // 2), 64, n)
    seg = np.lib.stride_tricks.sliding_window_view(rows, size, axis=1)[:, :: size - size // 2]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    p = np.abs(np.fft.rfft((seg - seg.mean(2, keepdims=True)) * hann, axis=2)) ** 2 / (hann**2).sum()
    p[..., 1 : -1 if size % 2 == 0 else None] *= 2  # both signs of a frequency
    return np.arange(p.shape[2]) / size, p.mean(1)


def spectra(rows: np.ndarray) -> np.ndarray:
    """Of each row: whether a frequency stands out (two deviations over the mean), flatness, share above 1/4 and up to 1/8, entropy, centroid."""
    freq, p = power(rows)
    total = p.sum(1)
    with np.errstate(all="ignore"):
        flat = np.exp(np.where(p > 0, np.log(p), 0).sum(1) / (p > 0).sum(1)) / p.mean(1)
        q = p / (total + 1e-12)[:, None]
        entropy = -np.where(q > 1e-12, q * np.log(q + 1e-12), 0).sum(1) / np.log(p.shape[1] + 1e-12)
        out = [p.max(1) > p.mean(1) + 2 * p.std(1), np.where(total > 0, flat, 1), *(np.where(total > 0, p[:, x].sum(1) / total, 0) for x in (freq > 0.25, freq <= 0.125)), np.where((q > 1e-12).any(1), entropy, 1), np.where(total > 1e-12, (freq * p).sum(1) / total, 0)]
    return np.stack([np.clip(np.asarray(x, float), 0, 1) for x in out], 1)


def envelopes(rows: np.ndarray) -> np.ndarray:
    """Modulus of each row's analytic signal (half of its spectrum, doubled) at the row's last value."""
    n = rows.shape[1]
    keep = np.zeros(n)
    keep[0], keep[1 : (n + 1) // 2] = 1, 2
    if n % 2 == 0:
        keep[n // 2] = 1
    last = np.fft.ifft(np.fft.fft(np.eye(n), axis=1) * keep, axis=1)[:, -1]
    return np.abs(rows @ last)[:, None]


def tails(rows: np.ndarray, share: float = 0.1, least: int = 10, sure: float = 0.99) -> np.ndarray:
    """Shape, scale, value at risk and expected shortfall of each row's left, then right tail: a Pareto law by the moments of what lies beyond the `share` quantile.

    NaN where fewer than `least` values lie beyond it or they do not vary; risk and
    shortfall of a right tail with too few values are its own 99th percentile (0.001 at
    least) and a tenth more. All NaN for a row that hardly varies.
    """
    out = []
    for side in (-1, 1):
        x = side * rows
        u = np.quantile(x, 1 - share, axis=1) if side > 0 else -np.quantile(rows, share, axis=1)
        over = x > u[:, None]
        gap, n = np.sort(np.where(over, x - u[:, None], 0), 1), over.sum(1)  # in order: windows with the same tail give the same number
        with np.errstate(all="ignore"):
            m = gap.sum(1) / n
            v = np.where(gap > 0, (gap - m[:, None]) ** 2, 0).sum(1) / (n - 1)
            known = (n >= least) & (v > 1e-12)
            xi = 0.5 * (1 - m**2 / v)
            scale = m * (1 - xi)
            ratio = (1 - sure) / share if side < 0 else sure / (1 - share)
            risk = u + np.where(xi == 0, scale * np.log(ratio), scale / np.abs(xi) * (ratio**-xi - 1))
            short = risk + (scale + side * xi * (risk - u)) / (1 - xi)
        found = [np.where(known, xi, np.nan), np.where(known, scale, np.nan), np.where(known, side * risk, np.nan), np.where(known, side * short, np.nan)]
        if side > 0:
            for r in np.flatnonzero((n < least) & (n > 0)):
                some = gap[r, -n[r] :]
                found[2][r] = max(u[r] + (np.quantile(some, 0.99) if len(some) > 1 else some.mean()), 0.001)
                found[3][r] = 1.1 * found[2][r]
        out += found
    return np.where((rows.std(1) < 1e-8)[:, None], np.nan, np.stack(out, 1))


def rank_in_window(x: np.ndarray, n: int = 252, least: int = 10, row: int = 0) -> np.ndarray:
    """Share of the last n values (those there are, NaN counted as greater) that are at most the current one; NaN under `least` known ones. `row`: the place of x[0] in its history."""
    padded = np.concatenate([np.full(n - 1, np.nan), x])
    windows = np.lib.stride_tricks.sliding_window_view(padded, n)
    size = np.minimum(np.arange(len(x)) + row + 1, n)
    out = np.full(len(x), np.nan)
    for at in range(0, len(x), 4096):
        w = windows[at : at + 4096]
        enough = (~np.isnan(w)).sum(1) >= least
        out[at : at + 4096] = np.where(enough, (w <= w[:, -1:]).sum(1) / size[at : at + 4096], np.nan)
    return out


SHAPE_LENGTH, BAND = 20, 4
_T = np.linspace(0, 1, SHAPE_LENGTH)
_bell = lambda at, width: np.exp(-(((_T - at) / width) ** 2))
#: Twelve templates: lines, turns and the classical reversal and continuation shapes.
SHAPES: dict[str, np.ndarray] = {
    "rise": _T, "fall": -_T, "dip": np.abs(_T - 0.5), "peak": -np.abs(_T - 0.5), "double_top": _bell(0.25, 0.12) + _bell(0.75, 0.12), "double_bottom": -_bell(0.25, 0.12) - _bell(0.75, 0.12),
    "head_shoulder_top": 0.6 * _bell(0.2, 0.09) + _bell(0.5, 0.09) + 0.6 * _bell(0.8, 0.09), "head_shoulder_bottom": -0.6 * _bell(0.2, 0.09) - _bell(0.5, 0.09) - 0.6 * _bell(0.8, 0.09),
    "flag_up": np.where(_T < 0.5, 2 * _T, 1 - 0.4 * (_T - 0.5)), "flag_down": np.where(_T < 0.5, -2 * _T, -1 + 0.4 * (_T - 0.5)), "hammer": np.where(_T < 0.8, -_T, -0.8 + 4 * (_T - 0.8)), "shooting_star": np.where(_T < 0.8, _T, 0.8 - 4 * (_T - 0.8)),
}


def _z(rows: np.ndarray) -> np.ndarray:
    sd = rows.std(1, keepdims=True)
    return np.where(sd > 0, (rows - rows.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1), 0.0)


def warped(rows: np.ndarray, shape: np.ndarray, band: int = BAND) -> np.ndarray:
    """Dynamic time warping distance of each row to a shape within a band: all rows move through the same table together."""
    n, m = rows.shape[1], len(shape)
    d = np.full((m + 1, len(rows)), np.inf)
    d[0] = 0
    for i in range(1, n + 1):
        now = np.full_like(d, np.inf)
        for j in range(max(1, i * m // n - band), min(m, i * m // n + band) + 1):
            now[j] = np.abs(rows[:, i - 1] - shape[j - 1]) + np.minimum(np.minimum(d[j], now[j - 1]), d[j - 1])
        d = now
    return d[m]


def warped_to_shapes(rows: np.ndarray) -> np.ndarray:
    z = _z(rows)
    return np.stack([warped(z, _z(s[None])[0]) for s in SHAPES.values()], 1)
