"""Scene scores against their definitions in plain pandas, over kernel columns of any size and with nulls."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import bar_features


def test_scenes_equal_their_definitions(spark):
    rng = np.random.default_rng(21)
    n = 160
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    pdf = pd.DataFrame({"symbol": "x", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "open": close + rng.normal(0, 0.5, n), "high": close + 1.5, "low": close - 1.5, "close": close, "volume": rng.random(n) * 10})
    names = ["wpt_energy_cascade", "wpt_multi_scale_consistency", "wpt_breakout_confidence", "wpt_false_breakout_risk", "vp_width_ratio", "vp_entropy", "vp_poc_deviation", "vp_lv_ratio", "vp_hv_ratio", "liquidity_void_speed", "liquidity_void_price_impact", "void_retracement", "void_risk"]
    for k, name in enumerate(names):
        pdf[name] = np.where(rng.random(n) < 0.1, np.nan, rng.normal(0.5, 1, n) * (4 if "speed" in name or "impact" in name else 1))
    rows = spark.createDataFrame(pdf).withColumns({x: F.nanvl(x, F.lit(None).cast("double")) for x in names})
    u = {x: pdf[x].fillna(0).clip(0, 1) for x in names}
    part = lambda x, by: (pdf[x].fillna(0) / by).clip(0, 1)
    r2 = pd.Series([np.corrcoef(np.arange(max(0, i - 19), i + 1), np.log(close[max(0, i - 19) : i + 1]))[0, 1] ** 2 if i >= 2 else 0 for i in range(n)])
    mean, sd = pdf["close"].rolling(20).mean(), pdf["close"].rolling(20).std(ddof=0)
    ratio = (4 * sd / mean).fillna(0)
    squeezed = 1 / (1 + ratio)
    raw = (pdf["wpt_energy_cascade"].fillna(0) / ratio.where(ratio != 0)).fillna(0)
    log = np.log1p(raw.abs()) * np.sign(raw)
    deviation = log.rolling(50, min_periods=10).std()
    wick = (np.maximum(pdf["high"] - pdf[["open", "close"]].max(axis=1), pdf[["open", "close"]].min(axis=1) - pdf["low"]) / (pdf["high"] - pdf["low"])).clip(0, 1)
    bc, fr = u["wpt_breakout_confidence"], u["wpt_false_breakout_risk"]
    speed, thin = part("liquidity_void_speed", 3), 1 - part("vp_entropy", 2)
    want = {
        "compression_energy": ((log - log.rolling(50, min_periods=10).mean()) / deviation.where(deviation > 1e-12)).fillna(0).clip(-5, 5),
        "wpt_compression_score": squeezed * u["wpt_multi_scale_consistency"] * (1 - bc), "wpt_ignition_score": bc * (1 - fr), "wpt_absorption_score": bc * (1 - fr) * ((pdf["wpt_energy_cascade"].fillna(0) + 1) / 2).clip(0, 1), "wpt_exhaustion_score": fr * (1 - r2),
        "vp_compression_score": (1 - u["vp_width_ratio"]) * thin, "vp_ignition_score": part("vp_poc_deviation", 2) * u["vp_lv_ratio"], "vp_absorption_score": thin * u["vp_width_ratio"] * r2, "vp_exhaustion_score": u["vp_hv_ratio"] * (1 - r2),
        "liquidity_void_compression_score": speed * squeezed, "label_void_ignition_score": speed * part("liquidity_void_price_impact", 3) * (1 - u["void_risk"]) * bc, "label_void_absorption_score": speed * (1 - u["void_retracement"]) * (1 - u["void_risk"]) * r2, "label_void_exhaustion_score": speed * u["void_retracement"] * u["void_risk"] * (1 - r2),
        "wick_compression_score": (1 - wick) * squeezed, "wick_ignition_score": (1 - wick) * r2, "wick_absorption_score": (1 - wick) * r2, "wick_exhaustion_score": wick * (1 - r2),
    }
    groups = [*bar_features.KERNEL_FEATURES.values(), bar_features.FEATURES["fx018_wick_scenes"]]
    seen = set()
    for features in groups:
        got = bar_features.with_features(rows, features).toPandas().sort_values("ts")
        for name in features:
            assert np.allclose(got[name].astype(float).to_numpy(), want[name].to_numpy(), atol=1e-7), name
            seen.add(name)
    assert seen == set(want)
