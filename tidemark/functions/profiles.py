"""Value profiles (volume by price) of windows, and how well a price level has held, all windows of a batch together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins of a profile whose number follows the data.
FEWEST, MOST = 10, 100


def suggested_bins(p: np.ndarray) -> np.ndarray:
    """Of each row: its range over the width 2 IQR / n^(1/3), a tenth of the range where the IQR is 0."""
    upper, lower = np.percentile(p, [75, 25], axis=1)
    reach = p.max(1) - p.min(1)
    with np.errstate(all="ignore"):
        width = np.where(upper > lower, 2 * (upper - lower) / p.shape[1] ** (1 / 3), reach / 10)
        bins = np.clip(np.ceil(reach / width), FEWEST, MOST)
    return np.where(reach > 1e-10, bins, FEWEST).astype(np.int64)


@dataclass
class Profiles:
    """Volume by price of some windows; rows of hist have zeros beyond their own number of bins."""

    hist: np.ndarray
    bins: np.ndarray
    low: np.ndarray
    high: np.ndarray
    known: np.ndarray

    def edge(self, k: np.ndarray) -> np.ndarray:
        """Lower edge of bin k of each row."""
        return np.where(k == self.bins, self.high, self.low + k * ((self.high - self.low) / self.bins))

    def centre(self, k: np.ndarray) -> np.ndarray:
        return (self.edge(k) + self.edge(k + 1)) / 2

    @property
    def own(self) -> np.ndarray:
        return np.arange(self.hist.shape[1]) < self.bins[:, None]


def profiles(p: np.ndarray, v: np.ndarray, bins: int | None = None) -> Profiles:
    """Profiles of prices p and volumes v, rows by window; known where the row has a range and volume."""
    rows, n = p.shape
    low, high = p.min(1), p.max(1)
    known = high - low > 1e-10
    count = np.minimum(suggested_bins(p) if bins is None else np.full(rows, bins), n)
    reach = np.where(known, high - low, 1.0)
    out = Profiles(np.zeros((rows, count.max(initial=1))), count, low, high, known)
    at = np.minimum(((p - low[:, None]) / reach[:, None] * count[:, None]).astype(np.int64), count[:, None] - 1)
    wide = lambda k: np.where(k == count[:, None], high[:, None], low[:, None] + k * (reach / count)[:, None])
    at -= p < wide(at)  # a bin holds its lower edge
    at += (p >= wide(at + 1)) & (at < count[:, None] - 1)
    cell = np.arange(rows)[:, None] * out.hist.shape[1] + np.where(known[:, None], at, 0)
    out.hist = np.bincount(cell.ravel(), v.ravel(), out.hist.size).reshape(out.hist.shape)
    out.known = known & (out.hist.sum(1) > 0)
    return out


def value_area(f: Profiles, share: float = 0.7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fullest bin of each row, and the first and last bin of the area around it that grows to its richer neighbour (up, if alike) until it holds `share` of the volume."""
    r = np.arange(len(f.hist))
    peak = f.hist.argmax(1)
    up, down, held, wanted = peak.copy(), peak.copy(), f.hist[r, peak], f.hist.sum(1) * share
    while True:
        grow = (held < wanted) & ((up + 1 < f.bins) | (down > 0))
        if not grow.any():
            return peak, down, up
        above = np.where(up + 1 < f.bins, f.hist[r, np.minimum(up + 1, f.hist.shape[1] - 1)], 0.0)
        below = np.where(down > 0, f.hist[r, np.maximum(down - 1, 0)], 0.0)
        rise = grow & ((up + 1 < f.bins) & (above >= below) | (down == 0))
        fall = grow & ~rise
        up, down = up + rise, down - fall
        held = held + np.where(rise, above, 0.0) + np.where(fall, below, 0.0)


def nodes(f: Profiles, price: np.ndarray, width: np.ndarray) -> dict[str, np.ndarray]:
    """Bins half a deviation richer or poorer than the mean of the filled ones, and where a price lies among them."""
    filled = f.hist > 0
    n = filled.sum(1)
    with np.errstate(all="ignore"):
        mean = np.where(filled, f.hist, 0).sum(1) / n
        sd = np.sqrt(np.where(filled, (f.hist - mean[:, None]) ** 2, 0).sum(1) / n)
    varied = f.known & (sd > 0)
    rich = f.own & (f.hist > (mean + 0.5 * sd)[:, None]) & varied[:, None]
    poor = f.own & (f.hist < (mean - 0.5 * sd)[:, None]) & varied[:, None]
    edges = f.low[:, None] + np.arange(f.hist.shape[1] + 1) * ((f.high - f.low) / f.bins)[:, None]
    edges[np.arange(len(edges)), f.bins] = f.high
    centres = (edges[:, :-1] + edges[:, 1:]) / 2
    away = np.where(poor, np.abs(centres - price[:, None]), np.inf).min(1)
    here = np.clip((price[:, None] >= np.where(np.arange(edges.shape[1]) <= f.bins[:, None], edges, np.inf)).sum(1) - 1, 0, f.bins - 1)
    some = np.isfinite(away)
    with np.errstate(all="ignore"):
        return {
            "hvn_count": rich.sum(1).astype(float), "lvn_count": poor.sum(1).astype(float), "lvn_distance": np.where(some, away / (f.high - f.low), np.nan),
            "volume_density": np.where(f.known, f.hist[np.arange(len(f.hist)), here] / f.hist.max(1), 0.0), "price_in_lvn": (some & (away < width)).astype(float),
        }


def shape(f: Profiles, price: np.ndarray) -> dict[str, np.ndarray]:
    """Width, place of the price, skew, entropy and thin and thick shares of each profile."""
    total, own, reach = f.hist.sum(1), f.own, f.high - f.low
    centres = f.low[:, None] + (np.arange(f.hist.shape[1]) + 0.5) * (reach / f.bins)[:, None]
    with np.errstate(all="ignore"):
        q = f.hist / total[:, None]
        mean = (centres * q).sum(1)
        spread = np.sqrt((q * (centres - mean[:, None]) ** 2).sum(1))
        level = total / f.bins
        away = np.where(own, f.hist - level[:, None], 0)
        second = (away**2).sum(1) / f.bins
        skew = np.where(second > (np.finfo(float).eps * level) ** 2, (away**3).sum(1) / f.bins / second**1.5, np.nan)
        filled = (q > 0).sum(1)
        entropy = -np.where(q > 0, q * np.log(q + 1e-8), 0).sum(1)
        out = {
            "width_ratio": np.clip(2 * spread / reach, 0, 1), "poc_deviation": np.clip((price - f.centre(f.hist.argmax(1))) / reach, -1, 1), "skewness": np.tanh(skew),
            "entropy": np.where(filled > 1, entropy / (np.log(np.maximum(filled, 1)) + 1e-8), 0.0),
            "lv_ratio": (own & (f.hist < 0.3 * level[:, None])).sum(1) / f.bins, "hv_ratio": (own & (f.hist > 1.5 * level[:, None])).sum(1) / f.bins,
        }
    return {k: np.where(f.known, x, np.nan) for k, x in out.items()}


def agreement(a: Profiles, b: Profiles, heat: float = 0.075) -> np.ndarray:
    """Near 1 where the value areas of two profiles have the same ends, measured by the range of both."""
    (_, da, ua), (_, db, ub) = value_area(a), value_area(b)
    apart = np.abs(a.edge(ua + 1) - b.edge(ub + 1)) + np.abs(a.edge(da) - b.edge(db))
    reach = np.maximum(a.high, b.high) - np.minimum(a.low, b.low)
    with np.errstate(all="ignore"):
        return np.where(a.known & b.known, np.exp(-apart / (2 * reach) / heat), np.nan)


def level_quality(level: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, volume: np.ndarray | None, support: bool, tolerance: float = 0.5, ahead: int = 3, base: int = 20) -> np.ndarray:
    """How well a level has held in each window (rows by bars): touches, what followed them, and how recent they are; 0 without a touch.

    A touch is a bar within `tolerance` ATR of the level. What follows is the move away from
    it within `ahead` bars that the window still has, in ATR, counted if it goes the right
    way and, with volumes, if the touching bar traded no less than the mean of the `base`
    bars before it in the window (of the first bar, where it is the first): times the root of
    that ratio, 3 at most.
    """
    n = high.shape[1]
    reach = (atr * tolerance)[:, None]
    touch = (low <= level[:, None] + reach) & (high >= level[:, None] - reach)
    extreme = high if support else low
    pad = np.full((len(high), ahead), -np.inf if support else np.inf)
    later = np.lib.stride_tricks.sliding_window_view(np.concatenate([extreme[:, 1:], pad], 1), ahead, axis=1)[:, :n]
    move = later.max(2) - close if support else close - later.min(2)
    counted = touch & (move > 0) & (np.arange(n) < n - 1)
    with np.errstate(all="ignore"):
        gain = move / atr[:, None]
        if volume is not None:
            sums = np.concatenate([np.zeros((len(volume), 1)), np.cumsum(volume, 1)], 1)
            at = np.arange(n)
            start, stop = np.maximum(at - base, 0), np.maximum(at, 1)
            usual = (sums[:, stop] - sums[:, start]) / (stop - start)
            ratio = volume / (np.where(usual > 0, usual, 1.0) + 1e-10)
            counted &= ratio >= 1
            gain = gain * np.sqrt(np.minimum(ratio, 3))
        mean = np.where(counted, gain, 0).sum(1) / np.maximum(counted.sum(1), 1)
    touches, recent = touch.sum(1), touch[:, -base:].sum(1)
    score = 0.4 * np.minimum(touches, 5) + 0.4 * np.minimum(2 * mean, 3) + 0.2 * np.minimum(recent, 3)
    return np.where((touches > 0) & (atr > 0), score, 0.0)
