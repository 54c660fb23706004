"""Divergence columns against their definitions in plain pandas."""

import numpy as np
import pandas as pd

from tidemark.plans import divergence


def test_divergence_columns_equal_their_definitions_and_blocks_change_nothing():
    rng = np.random.default_rng(31)
    n = 2400
    close = pd.Series(100 + np.cumsum(rng.normal(0, 1, n)).round(1))
    flow, volume, r2 = pd.Series(np.cumsum(rng.normal(0, 5, n)).round()), pd.Series(rng.integers(1, 40, n).astype(float)), pd.Series(rng.random(n))
    r2[:2] = np.nan
    got = divergence.divergence_columns(close.to_numpy(), flow.to_numpy(), volume.to_numpy(), r2.to_numpy())
    rank = lambda s, k: s.rolling(k, min_periods=max(10, k // 3)).apply(lambda x: ((x <= x[-1]).sum() - 1) / (len(x) - 1), raw=True)
    speed = close.diff().ewm(span=6, adjust=False).mean()
    haste = speed.diff().ewm(span=4, adjust=False).mean()
    at, t = rank(close, 50), r2.fillna(0)
    p, half = at.fillna(0.5), lambda s: s.fillna(0.5)
    want = {"price_position": p}
    for d, name, tension, pressure in ((rank(flow, 50) - at, "cvd_divergence_score", "trend_div_tension", "div_location_pressure"), (rank(speed, 30) - at, "price_momentum_div_score", "momentum_div_tension", "momentum_location_pressure")):
        d = d.fillna(0)
        want |= {name: d, f"{name}_pct": half(rank(d, 540)), tension: np.sqrt(d.abs() * t), pressure: d.abs() * (p - 0.5).abs() * 2}
    want["trend_div_alignment"] = want["cvd_divergence_score"] * t
    want["price_velocity_pct"], want["price_accel_pct"] = half(rank(speed, 540)), half(rank(haste, 540))
    want["momentum_exhaustion_score"] = (1 - want["price_velocity_pct"]) * (1 - want["price_accel_pct"])
    want["cvd_exhaustion_score"] = want["cvd_divergence_score"].abs() * want["div_location_pressure"]
    want["location_amplifier"] = (p - 0.5).abs() * 2
    want["terminal_risk_score"] = want["momentum_exhaustion_score"] * want["cvd_exhaustion_score"] * want["location_amplifier"]
    want["volume_activity_pct"], want["volume_velocity_pct"] = half(rank(volume, 540)), half(rank(volume.diff().ewm(span=5, adjust=False).mean(), 540))
    want["volume_stability"] = half((volume.rolling(5).mean() / (volume.rolling(20).mean() + 1e-8)).clip(0, 2) / 2)
    want["volume_participation_score"] = want["volume_activity_pct"] * np.sqrt(want["volume_velocity_pct"]) * want["volume_stability"]
    assert set(want) == set(got) == set(divergence.NAMES)
    for name, x in want.items():
        assert np.allclose(got[name], x, atol=1e-9), name
    cut = slice(700, None)
    late = divergence.divergence_columns(*(x.to_numpy()[cut] for x in (close, flow, volume, r2)), row=700)
    early = divergence.divergence_columns(*(x.to_numpy()[:2200] for x in (close, flow, volume, r2)))
    assert all(np.allclose(late[k][1400:], got[k][2100:]) and np.allclose(early[k], got[k][:2200]) for k in got)
