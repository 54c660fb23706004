"""The weekly clock against a plain loop over pandas weeks."""

import numpy as np
import pandas as pd

from tidemark.operators import weekly


def test_weekly_positions_equal_a_loop_and_see_no_week_before_its_end(spark):
    rng = np.random.default_rng(7)
    ts = pd.date_range("2024-01-03 05:00", periods=120 * 7 * 4, freq="6h")  # starts and ends within a week
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, len(ts))))
    bars = pd.DataFrame({"symbol": "x", "ts": ts, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": 1.0})
    other = bars.iloc[:5].assign(symbol="new")
    read = lambda pdf: weekly.positions(spark.createDataFrame(pdf), spans=(5, 9)).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    got = read(pd.concat([bars, other]))
    week = (ts.normalize() + pd.to_timedelta(6 - ts.weekday, "D"))
    w = bars.groupby(week).agg(close=("close", "last"), high=("high", "max"), low=("low", "min"))
    means, x = {}, got[got["symbol"] == "x"].reset_index(drop=True)
    for span in (5, 9):
        e = [w["close"].iloc[0]]
        for v in w["close"].iloc[1:]:
            e.append(e[-1] + 2 / (span + 1) * (v - e[-1]))
        means[span] = [v if k + 1 >= span else None for k, v in enumerate(e)]
    under = [m is not None and c < m for c, m in zip(w["close"], means[5])]
    lower = [k > 0 and w["high"].iloc[k] < w["high"].iloc[k - 1] and w["low"].iloc[k] < w["low"].iloc[k - 1] for k in range(len(w))]
    both = lambda f, k: float(k > 0 and f[k] and f[k - 1])
    hits = 0
    for i in range(0, len(ts), 3):
        k = sum(w.index + pd.Timedelta(days=1) <= ts[i]) - 1
        for span in (5, 9):
            m = means[span][k] if k >= 0 else None
            v = x[f"weekly_ema_{span}_position"][i]
            assert pd.isna(v) if m is None else np.isclose(v, np.clip((close[i] - m) / close[i], -1, 1))
        want = (both(under, k), both(lower, k)) if k >= 0 else (0.0, 0.0)
        assert (x["weekly_close_below"][i], x["weekly_lower_high_lower_low"][i], x["weekly_macro_cycle_exit_signal"][i]) == (*want, want[0] * want[1])
        hits += want[0] * want[1]
    assert hits > 0 and got[got["symbol"] == "new"]["weekly_ema_5_position"].isna().all()
    cut = read(bars.iloc[:1500])
    pd.testing.assert_frame_equal(cut, x.iloc[:1500], check_exact=True)
