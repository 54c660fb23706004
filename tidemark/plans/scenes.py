"""Scene scores of bars out of wavelet energies, value profiles and liquidity voids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions import bar_features, filters, recursive
from tidemark.operators import labels
from tidemark.operators.bars import BY_TIME as f
from tidemark.plans.register import query
from tidemark.plans.rolling import energy_columns
from tidemark.plans.structure import schema, with_profiles
from tidemark.plans.voids import liquidity_voids
from tidemark.sources import views

_ENERGY = ("wpt_energy_cascade", "wpt_multi_scale_consistency", "wpt_breakout_confidence", "wpt_false_breakout_risk")


def with_energies(bars: DataFrame) -> DataFrame:
    """bars with the wavelet energy columns that scenes read."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = energy_columns(pdf["close"].to_numpy(float), pdf["volume"].to_numpy(float), int(pdf["_n"].iloc[0]))
        return pdf[["symbol", "ts"]].assign(**{k: found[k] for k in _ENERGY})

    found = filters.overlapped(bars.select("symbol", "ts", "close", "volume"), ["symbol"], ["ts"], schema(_ENERGY), run, warm=60)
    return bars.join(found, ["symbol", "ts"])


@query("fx035_fx051_wavelet_scenes")
def _(spark, d):
    return bar_features.with_features(with_energies(views.hourly(spark, d)), bar_features.KERNEL_FEATURES["fx035_fx051_wavelet_scenes"])


@query("fx054_profile_scenes")
def _(spark, d):
    return bar_features.with_features(with_profiles(views.hourly(spark, d)), bar_features.KERNEL_FEATURES["fx054_profile_scenes"])


@query("fx052_void_scenes")
def _(spark, d):
    """Scenes of liquidity voids; those named label_ read the next three bars."""
    rows = labels.retracement(liquidity_voids(recursive.with_indicators(views.hourly(spark, d))), f, "liquidity_void_detected")
    rows = rows.withColumnsRenamed({"retracement": "void_retracement", "false_breakout_risk": "void_risk"})
    return bar_features.with_features(with_energies(rows), bar_features.KERNEL_FEATURES["fx052_void_scenes"])
