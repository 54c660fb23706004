"""Features against their definitions in plain pandas and numpy, and filters against one pass over everything."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidemark.functions import bar_features, filters, recursive


def walk(seed, n):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(rng.normal(0, 0.01, n).cumsum())
    open_ = np.concatenate([[100.0], close[:-1]])
    high, low = np.maximum(open_, close) * (1 + rng.uniform(0, 0.01, n)), np.minimum(open_, close) * (1 - rng.uniform(0, 0.01, n))
    volume = rng.uniform(1, 100, n).round(3)
    buy = (volume * rng.uniform(0, 1, n)).round(3)
    return pd.DataFrame({"symbol": f"s{seed}", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "open": open_, "high": high, "low": low, "close": close, "volume": volume, "buy_qty": buy, "sell_qty": volume - buy, "taker_buy_ratio": buy / volume})


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(pd.concat([walk(1, 1500), walk(2, 640)])).repartition(3)


@pytest.fixture(scope="module")
def rows(spark, bars):
    """Small batches, so that state is carried over many of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    out = recursive.with_indicators(bars).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return out


def table(spark, d):
    """NaN is null."""
    return spark.createDataFrame(pa.Table.from_pandas(d, preserve_index=False))


def seeded(x, n, weight, skip=0):
    x = np.asarray(x, float)
    out = np.full(len(x), np.nan)
    first = np.flatnonzero(~np.isnan(x))[0] + skip
    out[first + n - 1] = x[first : first + n].mean()
    for i in range(first + n, len(x)):
        out[i] = out[i - 1] + weight * (x[i] - out[i - 1])
    return out


def true_range(d):
    before = d.close.shift()
    return pd.concat([d.high - d.low, (d.high - before).abs(), (d.low - before).abs()], axis=1).max(axis=1).where(before.notna())


def test_recursive_indicators_equal_one_pass(rows):
    for _, d in rows.groupby("symbol"):
        move = d.close.diff()
        atr = seeded(true_range(d), 14, 1 / 14)
        gain, loss = seeded(move.clip(lower=0), 14, 1 / 14), seeded((-move).clip(lower=0), 14, 1 / 14)
        macd = seeded(d.close, 12, 2 / 13, 14) - seeded(d.close, 26, 2 / 27)
        fixed = seeded(d.close, 12, 0.15, 14) - seeded(d.close, 26, 0.075)
        want = {
            "ema_20": seeded(d.close, 20, 2 / 21), "ema_200": seeded(d.close, 200, 2 / 201), "ewm_50": d.close.ewm(span=50).mean(), "volume_ewm_20": d.volume.ewm(span=20, min_periods=10).mean(), "atr": atr, "natr": 100 * atr / d.close,
            "rsi": 100 * gain / (gain + loss), "cmo": 100 * (gain - loss) / (gain + loss), "macd": macd, "macd_signal": seeded(macd, 9, 0.2), "macdfix": fixed, "macdfix_signal": seeded(fixed, 9, 0.2),
        }
        for name, x in want.items():
            assert np.allclose(d[name], x, equal_nan=True), name
        adx = d.adx.to_numpy()
        assert np.allclose(d.adxr[13:], (adx[13:] + adx[:-13]) / 2, equal_nan=True) and (d.plus_di.dropna() >= 0).all()
        assert np.allclose(d.sar_ext.abs(), d.sar, equal_nan=True)
    assert rows.ema_1200.notna().sum() == 301


def test_zigzag_and_parabolic_do_not_depend_on_batches(rows):
    for _, d in rows.groupby("symbol"):
        zig, sar = recursive.ZigZag(), recursive.Parabolic()
        steps = [(*zig.step(h, low), sar.step(h, low)[0]) for h, low in zip(d.high, d.low)]
        assert np.allclose(d[["zigzag", "zz_high", "zz_low", "sar"]], steps, equal_nan=True)
    z = recursive.ZigZag(0.2)
    assert [z.step(h, low) for h, low in ((10, 9), (12, 11), (11, 10), (9, 8), (10, 9), (13, 12))] == [(10, 10, 10), (12, 12, 10), (12, 12, 10), (8, 12, 8), (10, 10, 8), (13, 13, 8)]


def z(x, n, least):
    return ((x - x.rolling(n, min_periods=least).mean()) / x.rolling(n, min_periods=least).std().replace(0, np.nan)).fillna(0)


def percentile(x, n=540):
    return x.rolling(n, min_periods=n).apply(lambda a: np.mean(a[:-1] <= a[-1]), raw=True).shift()


def defined(d):
    """The definitions, written again in pandas."""
    c, h, low, v, atr = d.close, d.high, d.low, d.volume, d.atr
    mid, sd = c.rolling(20).mean(), c.rolling(20).std(ddof=0)
    width, hl = 4 * sd, h - low
    roc = c.pct_change(5)
    floor = roc.abs().quantile(0.01)
    vwap = (c * v).rolling(20, min_periods=1).sum() / v.rolling(20, min_periods=1).sum()
    sma = c.rolling(200).mean()
    path = (c.diff().abs().fillna(0) / (atr + 1e-9)).rolling(20).sum()
    efficient = ((c - c.shift(19)).abs() / (atr + 1e-9) / path).clip(0, 1)
    share = atr.rolling(540, min_periods=1).apply(lambda a: np.mean(a[~np.isnan(a)] <= a[-1]) if not np.isnan(a[-1]) else np.nan, raw=True)
    memory, run, kept, held = [], 0, 0.0, []
    for s in share:
        run = run + 1 if (0 if np.isnan(s) else s) <= 0.2 else 0
        kept = max(max(0.0, (0.2 - (0.5 if np.isnan(s) else s)) / 0.2), 0.97 * kept)
        memory.append(kept)
        held.append(min(1, run / 540))
    signs = pd.concat([np.sign(c.pct_change(k)).fillna(0) for k in (3, 5, 10)], axis=1)
    vol = c.pct_change().fillna(0).rolling(20, min_periods=10).std()
    cvd = (d.buy_qty - d.sell_qty).cumsum()
    swing_high, swing_low = h.rolling(240, min_periods=120).max().shift(12), low.rolling(240, min_periods=120).min().shift(12)
    box_hi, box_lo = h.rolling(120).max(), low.rolling(120).min()
    r = c.pct_change().fillna(0)
    return {
        "bb_width_normalized": (width / atr).fillna(0), "bb_position": ((c - mid + 2 * sd) / width).fillna(0.5).clip(0, 1), "range_ratio_5bar": z(np.log1p((hl.rolling(5).mean() / hl.rolling(20).mean()).fillna(1)), 50, 5),
        "price_range_symmetry": (lambda raw: z(np.log1p(raw.abs()) * np.sign(raw), 50, 5))(((h - c) / (c - low).replace(0, np.nan)).fillna(1)), "volatility_reversal_score": z(atr, 50, 50), "volume_anomaly": z(np.log1p((v / v.ewm(span=20, min_periods=10).mean()).fillna(1)), 50, 10),
        "roc_5": ((roc - roc.rolling(50, min_periods=5).mean()) / roc.rolling(50, min_periods=5).std().clip(lower=floor)).fillna(0), "trend_confidence": signs.abs().mean(axis=1) * signs.mean(axis=1).abs(),
        "atr_percentile": atr.rolling(540).apply(lambda a: np.mean(a <= a[-1]), raw=True).shift(), "path_length_pct": percentile(path), "path_efficiency_pct": percentile(efficient), "jump_risk_pct": percentile((r.abs().rolling(10).max() / r.rolling(10).std()).shift()),
        "compression_duration": pd.Series(held, d.index), "recent_compression_decay": pd.Series(memory, d.index).clip(0, 1), "expanding_high_drawdown": (c / h.cummax() - 1).clip(-1, 0), "price_to_vwap_pct": ((c - vwap) / c).clip(-1, 1), "price_to_vwap_ratio": (c / vwap).clip(0.2, 5),
        "volume_ratio": (v / v.rolling(20, min_periods=1).mean()).clip(0, 10), "sma_200_slope": (sma.diff(5) / sma).fillna(0), "sma_200_position": ((c - sma) / c).clip(-1, 1).fillna(0), "tbr_spike": (d.taker_buy_ratio > 1.5 * d.taker_buy_ratio.rolling(5, min_periods=1).mean()).astype(float),
        "compression_score": 1 / (1 + (width / mid).fillna(0)), "ema_200_position": ((c - d.ema_200) / c).clip(-1, 1).fillna(0), "vol_zscore": (vol - vol.rolling(20, min_periods=10).mean()) / (vol.rolling(20, min_periods=10).std() + 1e-8), "vol_slope_10": (vol - vol.shift(9)) / (9 + 1e-8),
        "cvd_change_5_pct": percentile(cvd.diff(5)), "shd": cvd.diff().fillna(0).rolling(60, min_periods=30).corr(np.log(c / c.shift()).fillna(0)).abs().fillna(0), "wide_sr_dist_atr": np.minimum((c - swing_high).abs(), (c - swing_low).abs()) / atr, "box_hi_120": box_hi,
        "box_pos_120": ((c - box_lo) / (box_hi - box_lo)).clip(0, 1).fillna(0.5), "ema_50_200_cross_up": ((d.ema_50.shift() <= d.ema_200.shift()) & (d.ema_50 > d.ema_200)).astype(float),
        "macro_tp_vwap_1200_position": (lambda w: ((c - w) / c).clip(-1, 1).fillna(0))(((h + low + c) / 3 * v).rolling(1200, min_periods=60).sum() / v.rolling(1200, min_periods=60).sum()),
        "bars_since_local_high": pd.Series([(len(w) - 1 - int(np.argmax(w))) / 50 for w in (h.to_numpy()[max(0, i - 19) : i + 1] for i in range(len(h)))], d.index),
        "box_touches_lo_60": (lambda hi, lo: (low <= lo + np.maximum(atr.fillna(0), 0.015 * (hi + lo) / 2)).astype(float).rolling(60).sum().fillna(0))(h.rolling(60).max(), low.rolling(60).min()),
    }


def test_features_equal_their_definitions(spark, rows):
    every = {n: f for group in bar_features.FEATURES.values() for n, f in group.items()}
    names = list(defined(rows[rows.symbol == "s1"]))
    made = bar_features.with_features(table(spark, rows), {n: every[n] for n in names}).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    for symbol, d in rows.groupby("symbol"):
        got = made[made.symbol == symbol]
        for n, want in defined(d).items():
            a, b = got[n].astype(float).to_numpy(), want.astype(float).to_numpy()
            assert np.allclose(a, b, equal_nan=True, atol=1e-9), (n, np.flatnonzero(~np.isclose(a, b, equal_nan=True, atol=1e-9))[:5], a[~np.isclose(a, b, equal_nan=True)][:5], b[~np.isclose(a, b, equal_nan=True)][:5])


def test_features_do_not_read_later_bars(spark, rows):
    """Whatever is appended changes no feature of earlier bars, but for those whose definition has a quantile of the whole history."""
    ahead = {"acceleration_3", "roc_5", "trend_volatility_alignment", "compression_to_breakout_prob"}
    d = rows[rows.symbol == "s2"]
    whole, part = (table(spark, x) for x in (d, d.head(600)))
    for group in ("fx010_to_fx024_price", "fx025_to_fx036_percentiles", "fx140_fx165_to_fx180_positions"):
        names = {n: f for n, f in bar_features.FEATURES[group].items() if n not in ahead}
        a, b = (bar_features.with_features(x, names).toPandas().sort_values("ts").head(600).reset_index(drop=True) for x in (whole, part))
        pd.testing.assert_frame_equal(a, b)


def plain_warp(a, b, band):
    n, m = len(a), len(b)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i * m // n - band), min(m, i * m // n + band) + 1):
            d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[n, m]


def test_rolling_kernels_on_every_bar_equal_one_row_at_a_time():
    x = np.random.default_rng(9).normal(size=300).cumsum()
    x[40] = np.nan
    found = filters.rolling(filters.warped_to_shapes, x, filters.SHAPE_LENGTH, len(filters.SHAPES))
    assert len(filters.SHAPES) == 12 and np.isnan(found[:19]).all() and np.isnan(found[40:60]).all() and not np.isnan(found[60:]).any()
    unit = lambda v: (v - v.mean()) / v.std()
    for i in (19, 75, 299):
        assert np.allclose(found[i], [plain_warp(unit(x[i - 19 : i + 1]), unit(s), filters.BAND) for s in filters.SHAPES.values()])


def test_blocks_of_a_rolling_kernel_equal_one_pass(spark):
    x = np.random.default_rng(1).normal(size=900).cumsum()
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "symbol string, ts long, close double")
    f = lambda p: p[["symbol", "ts"]].assign(e=p["close"].rolling(50, min_periods=1).max())
    got = filters.overlapped(df, ["symbol"], ["ts"], "symbol string, ts long, e double", f, block=200, warm=49).orderBy("ts").toPandas()["e"].to_numpy()
    assert np.array_equal(got, pd.Series(x).rolling(50, min_periods=1).max())


def test_ranks_of_values_equal_sorting(spark):
    from tidemark.operators import stats

    rng = np.random.default_rng(2)
    rows = [("ab"[k % 2], float(v)) for k, v in enumerate(rng.integers(0, 60, 900) / 7)]
    df = spark.createDataFrame([*rows, ("a", None)], "k string, v double")
    want = pd.DataFrame(rows, columns=["k", "v"])
    want["place"] = want.groupby("k").v.rank()
    got = stats.ranks_of_values(df, "v", "k", parts=7).toPandas().set_index(["k", "v"]).place
    assert all(got[k, v] == p for k, v, p in want.itertuples(index=False))
    alone = stats.ranks_of_values(df, "v", parts=5).toPandas().set_index("v")["rank"]
    assert np.allclose([alone[v] for v in want.v], want.v.rank(pct=True))


def test_one_series_joins(spark):
    from tidemark.operators import joins

    rng = np.random.default_rng(3)
    base = pd.Timestamp("2024-01-01")
    left = [(i, (base + pd.Timedelta(minutes=int(m))).to_pydatetime()) for i, m in enumerate(rng.integers(0, 14 * 1440, 300))]
    right = [(i, (base + pd.Timedelta(minutes=int(m))).to_pydatetime(), float(i)) for i, m in enumerate(rng.integers(0, 9 * 1440, 60))]
    lf, rt = spark.createDataFrame(left, "i long, ts timestamp"), spark.createDataFrame(right, "seq long, at timestamp, v double")
    got = {r.i: r.v for r in joins.asof_one_series(lf, rt, "ts", "at", ["v"], "seq").collect()}
    for i, t in left:
        before = [(at, s, v) for s, at, v in right if at <= t]
        assert got[i] == (max(before)[2] if before else None)
    cut = joins.in_blocks(rt, "at", "seq", warm=4, block=10).toPandas()
    order = [s for s, _, _ in sorted(right, key=lambda r: (r[1], r[0]))]
    assert cut[cut._own].sort_values("_n").seq.tolist() == order
    assert all(sorted(g._n) == list(range(max(0, 10 * b - 4), min(60, 10 * b + 10))) for b, g in cut.groupby("_block") if b < 6)
