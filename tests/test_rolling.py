"""Envelopes, exponents, spectra, tails and energies against plain loops, one window at a time."""

import numpy as np
import pandas as pd
import pytest

from tests.test_structure import plain_packets, plain_rebuilt, rows_of
from tidemark.functions import filters
from tidemark.plans import rolling


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(12)
    close = 100 * np.exp(np.cumsum(rng.standard_t(4, 600) * 0.02))
    return close * (1 + rng.random(600) / 50), close * (1 - rng.random(600) / 50), close, rng.integers(1, 50, 600).astype(float), rng.normal(0, 20, 600).round()


def test_hurst_equals_a_loop():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(size=(4, 50)), np.zeros((1, 50)), np.full((1, 50), 0.3)])
    for got, x in zip(filters.hursts(rows)[:, 0], rows):
        if np.allclose(x, 0):
            assert np.isnan(got)
            continue
        y, found = np.cumsum(x - x.mean()), []
        for s in sorted({int(v) for v in np.logspace(np.log10(4), np.log10(12), 8)}):
            parts = [y[k * s : (k + 1) * s] for k in range(50 // s)]
            gaps = [p - np.polyval(np.polyfit(np.arange(s), p, 1), np.arange(s)) for p in parts]
            found.append((np.log(s), np.log(max(np.mean([np.sqrt(np.mean(g**2)) for g in gaps]), 1e-9))))
        assert np.isclose(got, np.clip(np.polyfit(*zip(*found), 1)[0], 0, 1), atol=1e-6)
    walk = np.cumsum(rng.normal(size=(40, 400)), 1)
    assert filters.hursts(walk).mean() > 0.9 > filters.hursts(np.diff(walk)).mean() > 0.4 > filters.hursts(np.diff(np.diff(walk))).mean()
    assert np.isnan(filters.hursts(rng.normal(size=(2, 19)))).all()


def plain_spectrum(x):
    size = min(max(8, len(x) // 2), 64)
    hann = [0.5 - 0.5 * np.cos(2 * np.pi * k / size) for k in range(size)]
    power = np.zeros(size // 2 + 1)
    starts = range(0, len(x) - size + 1, size // 2)
    for s in starts:
        seg = (x[s : s + size] - np.mean(x[s : s + size])) * hann
        for k in range(size // 2 + 1):
            c = sum(v * np.exp(-2j * np.pi * k * t / size) for t, v in enumerate(seg))
            power[k] += abs(c) ** 2 / sum(h * h for h in hann) * (1 if k in (0, size // 2) else 2) / len(starts)
    freq, total = np.arange(size // 2 + 1) / size, power.sum()
    q = power / (total + 1e-12)
    q = q[q > 1e-12]
    return [float(power.max() > power.mean() + 2 * power.std()), np.exp(np.log(power[power > 0]).mean()) / power.mean(), power[freq > 0.25].sum() / total, power[freq <= 0.125].sum() / total, -(q * np.log(q + 1e-12)).sum() / np.log(len(power)), (freq * power).sum() / total]


def test_spectra_equal_a_loop():
    rng = np.random.default_rng(2)
    rows = np.vstack([rng.normal(size=(3, 64)), np.sin(np.arange(64) * 0.7)[None] + rng.normal(size=(1, 64)) / 50])
    assert np.allclose(filters.spectra(rows), [plain_spectrum(x) for x in rows])
    assert filters.spectra(rows)[3, 0] == 1
    assert np.allclose(filters.spectra(np.full((1, 64), 2.0)), [[0, 1, 0, 0, 1, 0]])


@pytest.mark.parametrize("n", [64, 33])
def test_envelope_is_the_modulus_of_the_analytic_signal(n):
    rows = np.random.default_rng(n).normal(size=(5, n))
    spectrum = np.fft.fft(rows, axis=1)
    for k in range(n):
        spectrum[:, k] *= 1 if k == 0 or 2 * k == n else 2 if 2 * k < n else 0
    assert np.allclose(filters.envelopes(rows)[:, 0], np.abs(np.fft.ifft(spectrum, axis=1))[:, -1])
    t = np.arange(64)
    assert np.isclose(filters.envelopes(3 * np.cos(2 * np.pi * t / 16)[None])[0, 0], 3)


def plain_tail(x, right, least=10):
    u = np.quantile(x, 0.9 if right else 0.1)
    gap = x[x > u] - u if right else u - x[x < u]
    if len(gap) < least:
        risk = max(u + (np.quantile(gap, 0.99) if len(gap) > 1 else gap.mean()), 0.001) if right and len(gap) else np.nan
        return [np.nan, np.nan, risk, risk * 1.1]
    m, v = gap.mean(), gap.var(ddof=1)
    if v <= 1e-12:
        return [np.nan] * 4
    xi = (1 - m * m / v) / 2
    scale = m * (1 - xi)
    if right:
        risk = u + scale / abs(xi) * ((0.99 / 0.9) ** -xi - 1)
        return [xi, scale, risk, risk + (scale + xi * (risk - u)) / (1 - xi)]
    risk = u - scale / abs(xi) * (0.1**-xi - 1)
    return [xi, scale, risk, risk - (scale + xi * (risk - u)) / (1 - xi)]


def test_tails_equal_sorting_each_window():
    rng = np.random.default_rng(3)
    rows = rng.standard_t(3, size=(30, 120)) * 0.01
    rows[20:24] = rows[20:24].round(2)  # ties at the quantile
    rows[24] = 0.01
    for got, x in zip(filters.tails(rows), rows):
        want = [*plain_tail(x, False), *plain_tail(x, True)] if x.std() >= 1e-8 else [np.nan] * 8
        assert np.allclose(got, want, equal_nan=True)


def test_rank_in_window_equals_a_loop():
    x = np.random.default_rng(4).integers(0, 9, 60).astype(float)
    x[:5] = np.nan
    got, late = filters.rank_in_window(x, 20, 10), filters.rank_in_window(x, 20, 10, row=7)
    for i in range(60):
        w = x[max(0, i - 19) : i + 1]
        enough = (~np.isnan(w)).sum() >= 10
        assert np.isclose(got[i], (w <= x[i]).mean()) if enough else np.isnan(got[i])
        if i >= 19:
            assert np.isclose(late[i], got[i])


def test_envelope_columns_equal_a_loop(series):
    high, low, close, volume, delta = series
    typical, cvd = (high + low + close) / 3, np.cumsum(delta)
    got = rolling.envelope_columns(typical, delta, volume)

    def fluctuation(x):
        out = np.zeros(len(x))
        for t in range(101, len(x)):
            w = x[t - 101 : t - 1]
            out[t] = w[-1] - plain_rebuilt(w, 3, ["aaa"])[-1]
        return out

    def env(x, n, span):
        out, at = np.full(len(x), np.nan), None
        for i in range(n, len(x)):
            spectrum = np.fft.fft(x[i - n : i])
            spectrum[1 : n // 2] *= 2
            spectrum[n // 2 + 1 :] = 0
            now = abs(np.fft.ifft(spectrum)[-1])
            at = now if at is None else at + 2 / (span + 1) * (now - at)
            out[i] = at
        return np.array([(out[max(0, i - 251) : i + 1] <= out[i]).mean() if (~np.isnan(out[max(0, i - 251) : i + 1])).sum() >= 10 else np.nan for i in range(len(x))])

    price, flow = env(fluctuation(typical), 64, 10), env(fluctuation(cvd), 64, 10)
    vol = env(volume - np.array([volume[max(0, i - 19) : i + 1].mean() for i in range(600)]), 32, 5)
    lag = lambda x: np.concatenate([[np.nan], x[:-1]])
    for name, want in (("hilbert_price_env", price), ("hilbert_cvd_env", flow), ("hilbert_volume_env", vol)):
        assert np.allclose(got[name], lag(want), equal_nan=True) and np.isnan(got[name]).sum() < 90
    assert np.allclose(got["hilbert_price_env_slope"][300:], (price - lag(price))[299:-1])
    i = 400
    ratio = np.log((np.nan_to_num(flow) + 1e-8) / (np.nan_to_num(price) + 1e-8))[i - 252 : i]
    assert np.isclose(got["hilbert_cvd_price_env_ratio"][i], (ratio[-1] - np.median(ratio)) / (np.quantile(ratio, 0.75) - np.quantile(ratio, 0.25) + 1e-8))
    for i in range(120, 600):
        want = price[i - 1] > np.nanmax(price[max(0, i - 21) : i - 1]) and flow[i - 1] < np.nanmax(flow[i - 20 : i]) and vol[i - 1] < vol[i - 2]
        assert got["hilbert_triple_divergence"][i] == float(want)


def test_tail_and_fractal_columns_use_the_bars_before(series):
    _, _, close, volume, delta = series
    got = rolling.fractal_columns(close, delta, volume, 0.5)
    r = close[1:] / close[:-1] - 1
    i = 333
    assert np.isclose(got["hurst_price_rolling"][i], filters.hursts(np.clip(r, -0.5, 0.5)[None, i - 52 : i - 2])[0, 0])
    assert np.isclose(got["hurst_cvd_rolling"][i], filters.hursts(delta[None, i - 51 : i - 1])[0, 0])
    assert np.isnan(got["hurst_price_rolling"][51]) and not np.isnan(got["hurst_price_rolling"][52])
    want = plain_spectrum(np.diff(volume)[i - 65 : i - 1])
    assert np.allclose([got[f"spectrum_volume_{x}"][i] for x in ("flatness", "high_freq_ratio", "low_freq_ratio", "entropy")], want[1:5])
    centroids = [plain_spectrum(r[k - 65 : k - 1])[5] for k in range(i - 251, i + 1)]
    assert np.isclose(got["spectrum_price_centroid"][i], np.mean(np.array(centroids) <= centroids[-1]))
    assert got["spectrum_price_flatness"][63] == 1 and np.isnan(got["spectrum_cvd_entropy"][63]) and not np.isnan(got["spectrum_cvd_entropy"][64])

    tail = rolling.tail_columns(close)
    shape, scale, at = np.full(600, np.nan), np.full(600, np.nan), None
    for t in range(121, 600):
        xi, s, *_ = plain_tail(r[t - 121 : t - 1], False)
        at = xi if at is None else at + 2 / 121 * (xi - at)
        shape[t], scale[t] = at, s
    for name, x, none in (("evt_tail_shape", shape, 0.3), ("evt_scale_left", scale, 0.001)):
        x = np.where(np.isnan(x), none, x)
        want = [0.5 if t < 9 else (x[max(0, t - 251) : t + 1] <= x[t]).mean() for t in range(600)]
        assert np.allclose(tail[name], want)


def test_volatility_columns_equal_their_definitions(series):
    close = pd.Series(series[2])
    got = rolling.volatility_columns(close)
    r = np.concatenate([[0], np.diff(close) / close[:-1]])
    i = 450
    a = np.abs(r)
    acf = [np.clip(np.corrcoef(a[k - 99 : k + 1], a[k - 100 : k])[0, 1], 0, 1) for k in range(i - 80, i + 1)]
    w = (2 / 3) ** np.arange(81)[::-1]
    assert np.isclose(got["vol_persistence"][i], np.dot(w, acf) / w.sum(), atol=1e-9)
    share = []
    for k in range(i - 59, i + 1):
        w = (19 / 21) ** np.arange(k, -1, -1)
        falls, rises = (np.dot(w[1:], r[1 : k + 1] ** 2 * (s * r[:k] > 0)) for s in (-1, 1))
        share.append(np.clip(2 * falls / (falls + rises) - 1, 0, 1))
    assert np.isclose(got["vol_leverage_asymmetry"][i], np.mean(share))
    big = np.array([float(a[k] > np.median(a[k - 59 : k + 1])) for k in range(i - 60, i + 1)])
    assert np.isclose(got["vol_clustering_strength"][i], np.clip(np.corrcoef(big[1:], big[:-1])[0, 1], 0, 1), atol=1e-9)


def test_energy_columns_equal_a_loop(series):
    close, volume = series[2], series[3]
    got = rolling.energy_columns(close, volume)
    lows = lambda p: p.count("a") / 4
    energy = lambda x: {p: float(np.square(v).sum()) for p, v in plain_packets(x, 4).items()}
    mids = []
    for i in range(600):
        if i < 20:
            assert all(got[k][i] == 0 for k in got)
            mids.append(0.0)
            continue
        p, v, e = energy(np.diff(np.log(close[i - 20 : i + 1]))), energy(volume[i - 20 : i + 1]), energy(np.diff(np.log(close[max(0, i - 21) : i])))
        band = lambda d, few: sum(x for q, x in d.items() if few(lows(q)))
        low, mid, high = ((band(p, few), band(v, few)) for few in (lambda x: x < 0.25, lambda x: 0.25 <= x < 0.75, lambda x: x >= 0.75))
        ratio = [b / (a + 1e-8) for a, b in (low, mid, high)]
        assert np.allclose([got[k][i] for k in ("wpt_vper_low", "wpt_vper_mid", "wpt_vper_high")], ratio)
        cascade = (low[0] + mid[0] - high[0]) / (low[0] + mid[0] + high[0])
        inner = [q for q in p if 0.25 <= lows(q) < 0.75]
        steady = sum(e[q] > 0 and (p[q] - e[q]) / e[q] > 0.1 for q in inner) / len(inner)
        past = np.array(mids[-20:])
        less, upto = (past < ratio[1]).sum(), (past <= ratio[1]).sum()
        place = (less + upto + (upto > less)) / 2 / 20 if i >= 40 else 0.5
        sure = np.clip((cascade + 1) / 2 * 0.4 + place * 0.3 + steady * 0.3, 0, 1)
        risk = min(sure + 0.3, 1) if high[0] > 2 * mid[0] and ratio[1] < 0.5 else 1 - sure
        assert np.allclose([got["wpt_energy_cascade"][i], got["wpt_multi_scale_consistency"][i], got["wpt_breakout_confidence"][i], got["wpt_false_breakout_risk"][i]], [cascade, steady, sure, risk])
        mids.append(ratio[1])


def test_later_bars_change_no_column(series):
    high, low, close, volume, delta = series
    for columns, inputs in ((rolling.envelope_columns, ((high + low + close) / 3, delta, volume)), (rolling.tail_columns, (close,)), (rolling.energy_columns, (close, volume)), (lambda *x: rolling.fractal_columns(*x, 0.5), (close, delta, volume))):
        full, part = columns(*inputs), columns(*(x[:450] for x in inputs))
        assert all(np.allclose(full[k][:450], part[k], equal_nan=True) for k in full)


def test_return_clip_follows_the_spread_of_returns(spark):
    rng = np.random.default_rng(5)
    rows = []
    for symbol, sd, jump in (("calm", 0.001, 0), ("mid", 0.02, 0), ("mid_jump", 0.011, 0.31), ("wild", 0.05, 0), ("wild_jump", 0.05, 0.7), ("short", 0.05, 0)):
        r = np.clip(rng.normal(0, sd, 300 if symbol != "short" else 10), -1.9 * sd, 1.9 * sd)
        r[5] = jump or r[5]
        rows += [(symbol, k, float(v)) for k, v in enumerate(100 * np.cumprod(1 + r))]
    got = rows_of(rolling.return_clip(spark.createDataFrame(rows, "symbol string, ts long, close double")).withColumnRenamed("clip", "ts"))
    assert dict(zip(got["symbol"], got["ts"])) == {"calm": 0.3, "mid": 0.5, "mid_jump": 0.7, "wild": 0.8, "wild_jump": 1.0, "short": 0.5}
