"""Wavelet, profile and level kernels against plain loops, one window at a time."""

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import profiles, wavelets
from tidemark.plans import structure


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 700)))
    high, low = close * (1 + rng.random(700) / 100), close * (1 - rng.random(700) / 100)
    close[300:480] = close[300]  # a stretch without any movement
    high[300:480] = low[300:480] = close[300]
    return high, low, close, rng.integers(1, 50, 700).astype(float)


# --- wavelets ---------------------------------------------------------------------------------
def plain_split(x):
    f = wavelets.SCALING
    low, high, n = list(f[::-1]), [(-1) ** (k + 1) * f[k] for k in range(8)], len(x)

    def at(i):
        while not 0 <= i < n:
            i = -1 - i if i < 0 else 2 * n - 1 - i
        return x[i]

    return [[sum(g[j] * at(2 * k + 1 - j) for j in range(8)) for k in range((n + 7) // 2)] for g in (low, high)]


def plain_packets(x, level):
    found = {"": list(x)}
    for _ in range(level):
        found = {p + c: y for p, v in found.items() for c, y in zip("ad", plain_split(v))}
    return found


def plain_join(low, high, n):
    f = wavelets.SCALING
    g = [(-1) ** (7 - k + 1) * f[7 - k] for k in range(8)]
    out = [0.0] * (2 * len(low) + 6)
    for k in range(len(low)):
        for j in range(8):
            out[2 * k + j] += low[k] * f[j] + high[k] * g[j]
    return out[6 : 6 + n]


def plain_rebuilt(x, level, keep):
    sizes = [len(x)]
    for _ in range(level):
        sizes.append((sizes[-1] + 7) // 2)
    found = {p: v if p in keep else [0.0] * len(v) for p, v in plain_packets(x, level).items()}
    for k in range(level - 1, -1, -1):
        found = {p: plain_join(found[p + "a"], found[p + "d"], sizes[k]) for p in {q[:-1] for q in found}}
    return np.array(found[""])


@pytest.mark.parametrize("n, level", [(100, 3), (160, 4), (99, 3), (33, 2)])
def test_packets_and_rebuilding(n, level):
    x = np.random.default_rng(n).normal(size=n)
    want = plain_packets(x, level)
    assert all(np.allclose(x @ m, want[p]) for p, m in wavelets.packets(n, level).items())
    assert np.allclose(wavelets.rebuilt(n, level, frozenset(want)), np.eye(n))
    order = wavelets.by_frequency(level)
    assert np.allclose(x @ wavelets.rebuilt(n, level, frozenset(order[:2])), plain_rebuilt(x, level, order[:2]))


def test_bands_rise_with_the_frequency_of_a_wave():
    t = np.arange(160)
    top = []
    for k, f in enumerate(np.linspace(0.02, 0.48, 12)):
        energy = wavelets.energies(np.sin(2 * np.pi * f * t)[None], 3)
        top.append(wavelets.by_frequency(3).index(max(energy, key=lambda p: energy[p][0])))
    assert top == sorted(top) and top[0] == 0 and top[-1] == 7


def test_wavelet_columns_equal_a_loop(series):
    high, low, close, volume = series
    typical = (high + low + close) / 3
    got = structure.energy_columns(typical, volume)
    for t in (0, 50, 101, 102, 103, 250, 490, 699):
        w, v = typical[max(0, t - 101) : max(0, t - 1)], volume[max(0, t - 101) : max(0, t - 1)]
        if t < 101:
            assert all(got[k][t] == 0 for k in got)
            continue
        energy = {p: sum(np.square(x)) for p, x in plain_packets(w, 3).items()}
        low_e, mid, top = (sum(e for p, e in energy.items() if p.count("d") in few) for few in ((0, 1), (2,), (3,)))
        assert np.allclose([got["low"][t], got["mid"][t], got["high"][t], got["mid_low"][t]], [*(x / sum(energy.values()) for x in (low_e, mid, top)), mid / low_e])
        trend = plain_rebuilt(w, 3, ["aaa"])[-1]
        assert np.allclose([got["trend"][t], got["fluctuation"][t], got["reconstructed"][t]], [trend, w[-1] - trend, w[-1]])
        of_volume = sum(np.square(np.concatenate(list(map(np.array, plain_packets(v, 3).values())))))
        assert np.isclose(got["vper"][t], of_volume / sum(energy.values())) and got["volume_low"][t] == 0  # the fourth split is not made
        energy = {p: sum(np.square(x)) for p, x in plain_packets(np.diff(np.log(w)), 3).items()}
        assert np.isclose(got["r_high"][t], energy["ddd"] / sum(energy.values())) if sum(energy.values()) else got["r_high"][t] == 0


# --- profiles ---------------------------------------------------------------------------------
def plain_profile(p, v, bins=None):
    if bins is None:
        q75, q25 = np.percentile(p, [75, 25])
        width = 2 * (q75 - q25) / len(p) ** (1 / 3) if q75 > q25 else np.ptp(p) / 10
        bins = int(np.clip(np.ceil(np.ptp(p) / width), 10, 100)) if np.ptp(p) > 1e-10 else 10
    hist, edges = np.histogram(p, min(bins, len(p)), (p.min(), p.max()), weights=v)
    up = down = int(hist.argmax())
    held = hist[up]
    while held < 0.7 * hist.sum() and (up + 1 < len(hist) or down > 0):
        above, below = hist[up + 1] if up + 1 < len(hist) else -1, hist[down - 1] if down else -1
        if above >= below:
            up, held = up + 1, held + above
        else:
            down, held = down - 1, held + below
    return hist, edges, down, up


@pytest.mark.parametrize("n, bins", [(160, None), (100, 50), (100, None)])
def test_profile_columns_equal_a_loop(series, n, bins):
    _, _, close, volume = series
    got = structure.profile_columns(close, volume, n, bins)
    soft = wavelets.smooth(n, 4)
    for t in [*range(n, 700, 37), 300, 470, 479, 480, 481, 699]:
        p, v, now = close[t - n : t] @ soft, volume[t - n : t], close[t]
        if np.ptp(p) <= 1e-10:
            assert all(np.isnan(got[k][t]) for k in got)
            continue
        hist, edges, down, up = plain_profile(p, v, bins)
        centres = (edges[1:] + edges[:-1]) / 2
        assert np.allclose([got["poc"][t], got["hal_high"][t], got["hal_low"][t]], [centres[hist.argmax()], edges[up + 1], edges[down]])
        assert np.isclose(got["poc_volume_ratio"][t], hist.max() / hist.sum())
        mean, sd = hist[hist > 0].mean(), hist[hist > 0].std()
        poor = hist < mean - 0.5 * sd
        assert (got["hvn_count"][t], got["lvn_count"][t]) == ((hist > mean + 0.5 * sd).sum(), poor.sum())
        if poor.any():
            away = np.abs(centres[poor] - now).min()
            assert np.isclose(got["lvn_distance"][t], away / np.ptp(p)) and got["price_in_lvn"][t] == float(away < np.ptp(p) / (bins or len(hist)))
        assert np.isclose(got["volume_density"][t], hist[np.clip(np.digitize(now, edges) - 1, 0, len(hist) - 1)] / hist.max())
        m = np.average(centres, weights=hist)
        assert np.isclose(got["width_ratio"][t], np.clip(2 * np.sqrt(np.average((centres - m) ** 2, weights=hist)) / np.ptp(p), 0, 1))
        d = hist - hist.mean()
        assert np.isclose(got["skewness"][t], np.tanh((d**3).mean() / (d**2).mean() ** 1.5))
        q = hist[hist > 0] / hist.sum()
        assert np.isclose(got["entropy"][t], -(q * np.log(q + 1e-8)).sum() / (np.log(len(q)) + 1e-8))
        assert np.isclose(got["lv_ratio"][t], (hist < 0.3 * hist.mean()).mean()) and np.isclose(got["hv_ratio"][t], (hist > 1.5 * hist.mean()).mean())
        if np.ptp(close[t - n : t]) > 1e-10:
            raw = plain_profile(close[t - n : t], v, bins)
            reach = max(close[t - n : t].max(), p.max()) - min(close[t - n : t].min(), p.min())
            apart = abs(raw[1][raw[3] + 1] - edges[up + 1]) + abs(raw[1][raw[2]] - edges[down])
            assert np.isclose(got["boundary_stability"][t], np.exp(-apart / (2 * reach) / 0.075))


def test_bins_hold_their_lower_edge():
    p = np.array([[0.0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 0.3, 0.7, 2.1]])
    v = np.arange(1.0, 16)[None]
    for bins in (1, 3, 7, 10):
        f = profiles.profiles(p, v, bins)
        assert f.hist[0].tolist() == np.histogram(p[0], bins, (0, 10), weights=v[0])[0].tolist()


# --- levels -----------------------------------------------------------------------------------
def plain_quality(level, high, low, close, volume, atr, support):
    if not atr > 0:
        return 0.0
    n = len(high)
    touch = [low[k] <= level + 0.5 * atr and high[k] >= level - 0.5 * atr for k in range(n)]
    if not any(touch):
        return 0.0
    gains = []
    for k in range(n - 1):
        if not touch[k]:
            continue
        move = max(high[k + 1 : k + 4]) - close[k] if support else close[k] - min(low[k + 1 : k + 4])
        ratio = 1.0
        if volume is not None:
            usual = np.mean(volume[max(0, k - 20) : k] if k else volume[:1])
            ratio = volume[k] / (usual + 1e-10)
        if move > 0 and ratio >= 1:
            gains.append(move / atr * (np.sqrt(min(ratio, 3)) if volume is not None else 1))
    return 0.4 * min(sum(touch), 5) + 0.4 * min(2 * (np.mean(gains) if gains else 0), 3) + 0.2 * min(sum(touch[-20:]), 3)


def test_level_columns_equal_a_loop(series):
    high, low, close, volume = series
    rng = np.random.default_rng(9)
    atr = np.abs(rng.normal(1.5, 0.4, 700))
    atr[:14], atr[200] = np.nan, 0.0
    poc, hal_high, hal_low = close * (1 + rng.normal(0, 0.005, 700)), close * 1.01, close * 0.99
    got = structure.level_columns(high, low, close, volume, atr, poc, hal_high, hal_low, np.arange(700))
    scale = np.nan_to_num(atr)
    strength = np.full(700, 0.5)
    for i in range(700):
        if i < 60:
            assert got["sqs_hal_high"][i] == got["sqs_hal_low"][i] == 0
            continue
        w, b = slice(i - 59, i + 1), slice(i - 60, i)
        assert np.isclose(got["sqs_hal_high"][i], plain_quality(hal_high[i], high[w], low[w], close[w], volume[w], scale[i], False))
        assert np.isclose(got["sqs_hal_low"][i], plain_quality(hal_low[i], high[w], low[w], close[w], volume[w], scale[i], True))
        quality = lambda level, support: plain_quality(level, high[b], low[b], close[b], None, scale[i - 1], support)  # noqa: B023, E731
        levels = [hal_high[i], hal_low[i], poc[i]]
        bonus = [1 + 0.15 * sum(abs(x - y) <= 0.5 * scale[i] for m, y in enumerate(levels) if m != k) for k, x in enumerate(levels)]
        s, r, above, trend = quality(poc[i], True), quality(poc[i], False), close[i] > poc[i], close[i - 1] - close[i - 3]
        weight = 0.7 if above and trend < 0 else 0.3 if not above and trend > 0 else 0.5
        strength[i] = max(quality(hal_high[i], False) * bonus[0], quality(hal_low[i], True) * bonus[1], (s * weight + r * (1 - weight)) * bonus[2], s, r, float(above), float(trend < 0), weight, 1 - weight)
    assert np.allclose(got["strength"], np.concatenate([[0.5], strength[:-1]]))
    levels = np.stack([hal_high, hal_low, poc])
    nearest = np.array([min(levels[:, i], key=lambda x: abs(x - close[i])) for i in range(700)])
    gap = np.concatenate([[0], ((close - nearest) / close)[:-1]])
    assert np.allclose(got["dist"], gap * close / np.where(scale == 0, 1e-8, scale))
    assert (got["side"][1:] == np.where(close < nearest, 1, -1)[:-1]).all()


# --- through Spark ------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def table(spark, series):
    high, low, close, volume = series
    ts = pd.date_range("2024-01-01", periods=700, freq="h")
    pdf = pd.DataFrame({"symbol": "x", "ts": ts, "open": close, "high": high, "low": low, "close": close, "volume": volume})
    return pd.concat([pdf, pdf.iloc[:90].assign(symbol="short")])


def rows_of(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def test_blocks_and_later_bars_change_nothing(spark, table, monkeypatch):
    whole = spark.createDataFrame(table)
    some = spark.createDataFrame(table[table["ts"] < table["ts"].iloc[600]])
    from tidemark.functions import filters, recursive

    full = {f: rows_of(f(whole if f is structure.with_wavelets else recursive.with_indicators(whole))) for f in (structure.with_wavelets, structure.with_profiles)}
    levels = rows_of(structure.with_levels(structure.with_profiles(recursive.with_indicators(whole))))
    plain = filters.overlapped
    monkeypatch.setattr(filters, "overlapped", lambda *a, **k: plain(*a, **k | {"block": 130}))
    for f, want in full.items():
        src = (lambda x: x) if f is structure.with_wavelets else recursive.with_indicators
        pd.testing.assert_frame_equal(rows_of(f(src(whole))), want)
        pd.testing.assert_frame_equal(rows_of(f(src(some))), want[want["ts"] < table["ts"].iloc[600]].reset_index(drop=True))
    pd.testing.assert_frame_equal(rows_of(structure.with_levels(structure.with_profiles(recursive.with_indicators(whole)))), levels)
    assert levels["sqs_hal_high_pct"].notna().sum() == 160 and (levels[levels["symbol"] == "short"]["poc"] == 0).all()
