"""Feature columns over ordered bars, written once as expressions that Spark and DuckDB both read.

A feature is a function of a `Bars` builder: it asks for the frames it needs, each a column
of its own, and gives its expression; `with_features` computes whatever is ready together.
Inputs are the columns of bars and those of recursive.COLUMNS. Periods, warm-up (`least`
values in a frame) and what stands for an unknown value are those of the features'
definitions and are parameters here. A feature looks at the current and earlier bars only,
except where it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.functions.alphas import Levels, batches


class Bars(Levels):
    """Frames over a symbol's bars; every method gives the name of a column."""

    def __init__(self, dialect: str = "spark", ties: bool = False):
        super().__init__(dialect, "symbol", "ts", ties)

    def some(self, function: str, x: str, n: int, least: int = 1) -> str:
        x = self.level(x)
        return self.add(f"CASE WHEN count({x}) OVER {self.frame(n)} >= {least} THEN {function}({x}) OVER {self.frame(n)} END")

    def z(self, x: str, n: int, least: int, lag: int = 0) -> str:
        """(x - mean) / deviation of the frame, unknown where nothing varies; `lag`: of the frame that ended so many bars ago."""
        x = self.level(x)
        mean, sd = self.some("avg", x, n, least), self.some("stddev_samp", x, n, least)
        if lag:
            mean, sd = self.lag(mean, lag), self.lag(sd, lag)
        return self.add(f"CASE WHEN {sd} > 1e-12 THEN ({x} - {mean}) / {sd} END")

    def soft_z(self, x: str, n: int, least: int = 1, eps: str = "1e-10") -> str:
        x = self.level(x)
        return self.add(f"{self.near(f'({x} - {self.some("avg", x, n, least)})', 12)} / ({self.some('stddev_samp', x, n, least)} + {eps})")

    def share_below(self, x: str, n: int, least: int | None = None, own: bool = False) -> str:
        """The share of the n - 1 bars before (own: of all n) whose value is at most the current one; the frame must have `least` values."""
        x = self.level(x)
        values = self.add(self._list(x, n))
        size, keep, arrow = ("size", "filter", "q -> q") if self.dialect == "spark" else ("len", "list_filter", "lambda q: q")
        less = 0 if own else 1
        return self.add(f"CASE WHEN {size}({values}) >= {least or n} AND {size}({values}) > {less} AND {x} IS NOT NULL THEN ({size}({keep}({values}, {arrow} <= {x})) - {less}) / CAST({size}({values}) - {less} AS DOUBLE) END")

    def percent(self, x: str, n: int = 540) -> str:
        """Percentile among the n - 1 bars before, as it was one bar ago."""
        return self.lag(self.near(self.share_below(self.near(self.level(x), 12), n), 12) if self.ties else self.share_below(x, n), 1)

    def so_far(self, function: str, x: str) -> str:
        return self.add(f"{function}({self.level(x)}) OVER ({self.order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")

    def change(self, x: str, n: int = 1) -> str:
        x = self.level(x)
        return self.add(f"{x} / nullif({self.lag(x, n)}, 0) - 1")

    @property
    def clock(self) -> str:
        return self.add(f"CAST(row_number() OVER ({self.order}) AS DOUBLE)")

    def line(self, function: str, x: str, n: int) -> str:
        """regr_slope or regr_r2 of x on the bar number."""
        return self.add(f"{function}({self.level(x)}, {self.clock}) OVER {self.frame(n)}")

    def low_quantile(self, x: str, q: str) -> str:
        """A quantile over the symbol's whole history: it looks ahead, as the definition does."""
        name = "percentile" if self.dialect == "spark" else "quantile_cont"
        return self.add(f"{name}({self.level(x)}, {q}) OVER (PARTITION BY {self.key})")

    def run(self, condition: str) -> str:
        """For how many bars up to this one the condition has held."""
        number = self.clock
        broken = self.so_far("max", f"CASE WHEN {condition} THEN 0 ELSE {number} END")
        return self.add(f"{number} - {broken}")


def clip(x: str, low: str, high: str) -> str:
    """Keeps null null, in both dialects."""
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


def _or(x: str, other: str) -> str:
    return f"coalesce({x}, {other})"


def _roc_z(p: Bars, n: int) -> str:
    roc = p.change("close", n)
    mean, sd = p.some("avg", roc, 50, 5), p.some("stddev_samp", roc, 50, 5)
    floor = p.low_quantile(f"abs({roc})", "1e-2")
    return p.level(f"coalesce(CASE WHEN {sd} IS NOT NULL AND greatest({sd}, {floor}) > 0 THEN ({roc} - {mean}) / greatest({sd}, {floor}) END, 0)")


def _band(p: Bars) -> tuple[str, str]:
    return p.some("avg", "close", 20, 20), p.some("stddev_pop", "close", 20, 20)


def _bb_width(p: Bars) -> str:
    return p.level(f"coalesce(4 * {_band(p)[1]} / nullif(atr, 0), 0)")


def _volume_ratio(p: Bars) -> str:
    return p.level(_or(clip(f"(volume / nullif({p.some('avg', 'volume', 20)}, 0))", "0", "10"), "1"))


def _curvature(p: Bars) -> str:
    smooth = p.some("avg", "close", 5)
    v = p.level(_or(p.change(smooth), "0"))
    a = p.level(_or(p.delta(v, 1), "0"))
    bent = p.some("avg", f"abs({a}) / (power(1 + {v} * {v}, 15e-1) + 1e-8)", 5)
    return _or(p.z(f"ln(1 + greatest({bent}, 0))", 200, 50, lag=1), "0")


def _signed_log(x: str) -> str:
    return f"ln(1 + abs({x})) * sign({x})"


def _r2(p: Bars, n: int) -> str:
    return f"CASE WHEN {p.clock} >= 3 THEN coalesce({p.line('regr_r2', 'ln(close)', n)}, 0) END"


def _path(p: Bars) -> str:
    return p.sum(f"CASE WHEN atr IS NOT NULL THEN coalesce(abs({p.delta('close', 1)}), 0) / (atr + 1e-9) END", 20)


def _efficiency(p: Bars) -> str:
    net = f"abs(close - {p.lag('close', 19)}) / (atr + 1e-9)"
    return p.level(clip(f"({net} / nullif({_path(p)}, 0))", "0", "1"))


def _consistency(p: Bars) -> str:
    return p.level(f"abs({p.mean(f'coalesce(sign({p.delta("close", 1)}), 0)', 20)})")


def _slope(p: Bars, x: str) -> str:
    """Of the last five bars, or all before; 0 where a value is unknown."""
    x = p.level(x)
    w = p.frame(5)
    return p.level(f"CASE WHEN count({x}) OVER {w} >= 2 AND count({x}) OVER {w} = count(*) OVER {w} THEN regr_slope({x}, {p.clock}) OVER {w} ELSE 0 END")


def _atr_percentile(p: Bars) -> str:
    return p.lag(p.share_below("atr", 540, own=True), 1)


def _atr_share(p: Bars) -> str:
    """As of now, over the atr values of the last 540 bars."""
    return p.share_below("atr", 540, least=1, own=True)


def _vol(p: Bars, n: int = 20) -> str:
    return p.some("stddev_samp", _or(p.change("close"), "0"), n, n // 2)


def _atr_filled(p: Bars) -> str:
    """Null before the first value, where the definition fills from later bars."""
    return p.level("CASE WHEN atr IS NOT NULL THEN greatest(atr, 1e-8) END")


def _cross(p: Bars, fast: str, slow: str, up: bool, valid: str) -> str:
    fast, slow = p.level(fast), p.level(slow)
    before, now = ("<=", ">") if up else (">=", "<")
    return f"CASE WHEN {valid} AND {p.lag(fast, 1)} {before} {p.lag(slow, 1)} AND {fast} {now} {slow} THEN 1e0 ELSE 0e0 END"


def _position(ma: str) -> str:
    return _or(clip(f"((close - {ma}) / nullif(close, 0))", "-1", "1"), "0")


def _macro_vwap(p: Bars, n: int = 1200) -> str:
    least = max(3, min(n // 10, max(50, n // 20)))
    return p.level(_position(f"({p.some('sum', '(high + low + close) / 3 * volume', n, least)} / nullif({p.some('sum', 'volume', n, least)}, 0))"))


def _over_atr(x: str) -> str:
    return f"coalesce({x} * close / nullif(atr, 0), 0)"


def _macdext(p: Bars) -> str:
    return p.level(f"{p.mean('close', 12)} - {p.mean('close', 26)}")


def _box(p: Bars, n: int) -> dict[str, str]:
    hi, lo = p.some("max", "high", n, n), p.some("min", "low", n, n)
    mid, width = p.level(f"({hi} + {lo}) / 2"), p.level(f"CASE WHEN {hi} IS NOT NULL THEN greatest({hi} - {lo}, 1e-12) END")
    tol = p.level(f"CASE WHEN {mid} IS NOT NULL THEN greatest(coalesce(atr, 0), 15e-3 * abs({mid})) END")
    full = f"{p.clock} >= {n}"
    r2 = p.level(f"CASE WHEN {full} THEN coalesce({p.line('regr_r2', 'close', n)}, 0) END")
    near_hi, near_lo = (p.level(f"CASE WHEN {x} THEN 1 ELSE 0 END") for x in (f"high >= {hi} - {tol}", f"low <= {lo} + {tol}"))
    return {
        f"box_hi_{n}": hi, f"box_lo_{n}": lo, f"box_width_pct_{n}": f"{width} / nullif({mid}, 0)", f"box_pos_{n}": _or(clip(f"((close - {lo}) / {width})", "0", "1"), "5e-1"),
        f"box_stability_{n}": _or(clip(f"(1 - {r2})", "0", "1"), "0"), f"box_touches_hi_{n}": f"CAST({_or(p.sum(near_hi, n), '0')} AS DOUBLE)", f"box_touches_lo_{n}": f"CAST({_or(p.sum(near_lo, n), '0')} AS DOUBLE)",
    }


def _box_part(name: str, n: int) -> Callable[[Bars], str]:
    return lambda p: _box(p, n)[name]


def _regime(p: Bars) -> str:
    b = _box(p, 120)
    s, w = p.level(b["box_stability_120"]), p.level(b["box_width_pct_120"])
    return p.level(f"CASE WHEN {s} < 7e-1 OR {w} IS NULL THEN 'none' WHEN {w} <= 4e-2 THEN 'small' WHEN {w} <= 8e-2 THEN 'mid' ELSE 'big' END")


def _breakout(p: Bars, edge: str, sign: str) -> str:
    return f"CASE WHEN close {sign} {p.lag(_box(p, 120)[edge], 1)} AND {p.lag(_regime(p), 1)} <> 'none' THEN 1 ELSE 0 END"


def _dist(p: Bars) -> tuple[str, str, str, str]:
    """The swing high and low of 240 bars as of 12 bars ago, and the distances to them in ATR."""
    hi, lo = p.lag(p.some("max", "high", 240, 120), 12), p.lag(p.some("min", "low", 240, 120), 12)
    return hi, lo, p.level(f"abs(close - {hi}) / nullif(atr, 0)"), p.level(f"abs(close - {lo}) / nullif(atr, 0)")


WIDTHS = (60, 120, 240, 480, 1200)

#: By inventory ids: the columns of each feature.
def _unit(x: str) -> str:
    return f"greatest(least(coalesce({x}, 0), 1), 0)"


def _trend(p: Bars) -> str:
    return p.level(_unit(_r2(p, 20)))


def _width_ratio(p: Bars) -> str:
    return f"coalesce(4 * {_band(p)[1]} / nullif({_band(p)[0]}, 0), 0)"


def _squeezed(p: Bars) -> str:
    return p.level(f"1 / (1 + {_width_ratio(p)})")


def _rejected(p: Bars) -> str:
    """The longer wick over the range."""
    return p.level(_unit("greatest(high - greatest(open, close), least(open, close) - low) / nullif(high - low, 0)"))


FEATURES: dict[str, dict[str, Callable[[Bars], str]]] = {
    "fx001_fx002_fx008_fx009_base": {
        "atr_filled": lambda p: _or("atr", "0"), "weekday": lambda p: f"CAST({_weekday(p)} AS DOUBLE)", "monday_return": lambda p: f"CASE WHEN {_weekday(p)} = 0 THEN {p.change('close')} END",
        "monday_down": lambda p: f"CASE WHEN {_weekday(p)} = 0 THEN CASE WHEN {p.change('close')} < 0 THEN 1e0 ELSE 0e0 END END", "rsi_filled": lambda p: _or("rsi", "50"),
        "macd_atr": lambda p: "coalesce(macd / coalesce(nullif(atr, 0), 1e-8), 0)", "macd_signal_atr": lambda p: "coalesce(macd_signal / coalesce(nullif(atr, 0), 1e-8), 0)", "macd_histogram_atr": lambda p: "coalesce((macd - macd_signal) / coalesce(nullif(atr, 0), 1e-8), 0)",
    },
    "fx010_to_fx024_price": {
        "acceleration_3": lambda p: p.delta(_roc_z(p, 3), 1), "path_curvature": _curvature,
        "volatility_cone_position": lambda p: _or(p.lag(p.share_below(p.near(_vol(p), 12), 252), 1), "5e-1"),
        "bb_width_normalized": _bb_width, "bb_position": lambda p: _or(clip(f"((close - {_band(p)[0]} + 2 * {_band(p)[1]}) / nullif(4 * {_band(p)[1]}, 0))", "0", "1"), "5e-1"),
        "range_ratio_5bar": lambda p: _or(p.z(f"ln(1 + coalesce({p.mean('high - low', 5)} / nullif({p.mean('high - low', 20)}, 0), 1))", 50, 5), "0"),
        "volatility_reversal_score": lambda p: _or(p.z("atr", 50, 50), "0"), "price_range_symmetry": lambda p: _or(p.z(_signed_log(p.level("coalesce((high - close) / nullif(close - low, 0), 1)")), 50, 5), "0"),
        "wick_upper_ratio": lambda p: "coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0)", "wick_lower_ratio": lambda p: "coalesce((least(open, close) - low) / nullif(high - low, 0), 0)",
        "volume_anomaly": lambda p: _or(p.z("ln(1 + coalesce(volume / nullif(volume_ewm_20, 0), 1))", 50, 10), "0"), "roc_5": lambda p: _roc_z(p, 5), "trend_r2_20": lambda p: _r2(p, 20), "trend_r2_50": lambda p: _r2(p, 50),
        "trend_confidence": lambda p: f"({' + '.join(f'abs({s})' for s in _signs(p))}) / 3 * abs({' + '.join(_signs(p))}) / 3", "trend_direction_raw": lambda p: f"sign({' + '.join(_signs(p))})",
        "trend_direction": lambda p: f"CASE WHEN {' + '.join(_signs(p))} >= 0 THEN 'UP' ELSE 'DOWN' END",
        "slope_consistency_score": lambda p: (lambda s: " + ".join(f"CASE WHEN {a} = {b} THEN 1 ELSE 0 END" for a, b in ((s[0], s[1]), (s[1], s[2]), (s[0], s[2]))))([p.level(f"sign({p.delta(x, 1)})") for x in ("ewm_10", "ewm_20", "ewm_50")]),
    },
    "fx018_wick_scenes": {
        "wick_compression_score": lambda p: f"(1 - {_rejected(p)}) * {_squeezed(p)}", "wick_ignition_score": lambda p: f"(1 - {_rejected(p)}) * {_trend(p)}",
        "wick_absorption_score": lambda p: f"(1 - {_rejected(p)}) * {_trend(p)}", "wick_exhaustion_score": lambda p: f"{_rejected(p)} * (1 - {_trend(p)})",
    },
    "fx025_to_fx036_percentiles": {
        "atr_percentile": _atr_percentile, "jump_risk_pct": lambda p: p.percent(_jump(p)), "path_length_pct": lambda p: p.percent(_path(p)), "path_efficiency_pct": lambda p: p.percent(_efficiency(p)), "price_dir_consistency_pct": lambda p: p.percent(_consistency(p)),
        "path_efficiency_slope_5": lambda p: _slope(p, p.percent(_efficiency(p))), "price_dir_consistency_slope_5": lambda p: _slope(p, p.percent(_consistency(p))), "trend_volatility_alignment": lambda p: f"coalesce(sign({_roc_z(p, 5)}), 0) * coalesce({_atr_percentile(p)}, 0)",
        "compression_duration": lambda p: _duration(p), "recent_compression_decay": lambda p: _memory(p), "compression_to_breakout_prob": lambda p: f"{p.level(_duration(p))} / (1 + exp(-{_roc_z(p, 5)}))",
    },
    "fx045_wide_swing": {
        "wide_sr_upper_px": lambda p: _dist(p)[0], "wide_sr_lower_px": lambda p: _dist(p)[1], "wide_sr_dist_atr": lambda p: f"CASE WHEN {_dist(p)[2]} IS NOT NULL AND {_dist(p)[3]} IS NOT NULL THEN least({_dist(p)[2]}, {_dist(p)[3]}) END",
        "wide_sr_side": lambda p: f"CASE WHEN {_dist(p)[2]} <= {_dist(p)[3]} THEN 1e0 ELSE -1e0 END", "wide_sr_range_width_atr": lambda p: f"({_dist(p)[0]} - {_dist(p)[1]}) / nullif(atr, 0)",
    },
    "fx066_to_fx073_flow_percentiles": {
        "cvd_change_5_pct": lambda p: p.percent(p.delta(_cvd(p), 5)), "cvd_change_5_normalized_pct": lambda p: p.percent(f"{p.some('sum', 'buy_qty - sell_qty', 5)} / nullif({p.some('sum', 'buy_qty + sell_qty', 5)}, 0)"), "volume_ratio_pct": lambda p: p.percent(_volume_ratio(p)), "bb_width_normalized_pct": lambda p: p.percent(_bb_width(p)),
        "shd": lambda p: _decoupling(p), "shd_pct": lambda p: p.percent(_decoupling(p)),
    },
    "fx108_to_fx115_volatility": {
        **{f"vol_raw_{n}": (lambda p, n=n: _vol(p, n)) for n in (5, 10, 20, 60)}, "vol_atr_norm": lambda p: f"{_atr_filled(p)} / greatest(close, 1e-8)",
        **{f"vol_atr_{k}_{n}": (lambda p, f=f, n=n: p.some(f, _atr_filled(p), n, n // 2)) for n in (5, 10, 20) for k, f in (("ma", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"))},
        "vol_atr_ratio_20": lambda p: f"{_atr_filled(p)} / ({p.some('avg', _atr_filled(p), 20, 10)} + 1e-8)", "vol_atr_change": lambda p: _or(p.change(_atr_filled(p)), "0"), "vol_atr_change_abs": lambda p: f"coalesce(abs({p.delta(_atr_filled(p), 1)}), 0)",
        **{f"vol_lag_{n}": (lambda p, n=n: p.lag(_vol(p), n)) for n in (1, 2, 3)}, **{f"vol_slope_{n}": (lambda p, n=n: f"{p.delta(_vol(p), n - 1)} / ({n - 1} + 1e-8)") for n in (5, 10, 20)}, "vol_accel": lambda p: _or(p.delta(f"{p.delta(_vol(p), 4)} / (4 + 1e-8)", 1), "0"),
        **{f"vol_ma_{n}": (lambda p, n=n: p.some("avg", _vol(p), n, n // 2)) for n in (5, 10, 20)}, "vol_zscore": lambda p: p.soft_z(_vol(p), 20, 10, "1e-8"),
        "vol_percentile_approx": lambda p: (lambda z: f"CASE WHEN {z} < -2 THEN 1e-2 + 9e-2 * ({z} + 4) / 2 WHEN {z} < 0 THEN 1e-1 + 4e-1 * ({z} + 2) / 2 WHEN {z} < 2 THEN 5e-1 + 4e-1 * {z} / 2 ELSE 9e-1 + 9e-2 * ({z} - 2) / 2 END")(p.level(clip(p.soft_z(_vol(p), 20, 10, "1e-8"), "-4", "4"))),
        **{f"vol_range_{n}": (lambda p, n=n: f"{p.some('max', _vol(p), n, n // 2)} - {p.some('min', _vol(p), n, n // 2)}") for n in (10, 20)},
        **{f"vol_range_pos_{n}": (lambda p, n=n: f"coalesce(({_vol(p)} - {p.some('min', _vol(p), n, n // 2)}) / (nullif({p.some('max', _vol(p), n, n // 2)} - {p.some('min', _vol(p), n, n // 2)}, 0) + 1e-8), 5e-1)") for n in (10, 20)},
        **{f"vol_mom_{n}": (lambda p, n=n: _or(p.change(_vol(p), n), "0")) for n in (3, 5, 10)},
    },
    "fx150_to_fx160_levels": {
        "zigzag_pivot": lambda p: "zigzag", "zz_high_value": lambda p: "zz_high", "zz_low_value": lambda p: "zz_low", "dist_to_zz_high": lambda p: "coalesce(abs(close - zz_high), 0)", "dist_to_zz_low": lambda p: "coalesce(abs(close - zz_low), 0)",
        "dist_to_zz_high_atr": lambda p: "coalesce(abs(close - zz_high) / nullif(atr, 0), 0)", "dist_to_zz_low_atr": lambda p: "coalesce(abs(close - zz_low) / nullif(atr, 0), 0)", "cvd_slope_5": lambda p: _slope(p, _cvd(p)), "atr_ratio": lambda p: "coalesce(atr / nullif(close, 0), 0)",
        "bb_width_ratio": lambda p: f"coalesce(4 * {_band(p)[1]} / nullif({_band(p)[0]}, 0), 0)", "compression_score": lambda p: f"1 / (1 + coalesce(4 * {_band(p)[1]} / nullif({_band(p)[0]}, 0), 0))", "tbr_ma_5": lambda p: _or(p.some("avg", "taker_buy_ratio", 5), "5e-1"),
        "tbr_spike": lambda p: f"CASE WHEN taker_buy_ratio > 15e-1 * {p.some('avg', 'taker_buy_ratio', 5)} THEN 1e0 ELSE 0e0 END",
    },
    "fx140_fx165_to_fx180_positions": {
        "sma_200_slope": lambda p: f"coalesce({p.delta(p.mean('close', 200), 5)} / nullif({p.mean('close', 200)}, 0), 0)", "sma_200_position": lambda p: _position(p.mean("close", 200)), "sma_slope_x_price_pos": lambda p: f"coalesce({p.delta(p.mean('close', 200), 5)} / nullif({p.mean('close', 200)}, 0), 0) * coalesce(close / nullif({p.mean('close', 200)}, 0), 1)",
        "ema_200_position": lambda p: _position("ema_200"), "ema_1200_position": lambda p: _position("ema_1200"), "expanding_high_drawdown": lambda p: clip(f"(close / nullif({p.so_far('max', 'high')}, 0) - 1)", "-1", "0"),
        "ema_1200_slope_10": lambda p: f"coalesce({p.delta('ema_1200', 10)} / nullif(ema_1200, 0), 0)", "macro_tp_vwap_1200_position": _macro_vwap,
        "ema_vwap_1200_cross_up": lambda p: _cross(p, f"close * (1 - {p.level(_position('ema_1200'))})", f"close * (1 - {_macro_vwap(p)})", True, "close IS NOT NULL"), "ema_vwap_1200_cross_down": lambda p: _cross(p, f"close * (1 - {p.level(_position('ema_1200'))})", f"close * (1 - {_macro_vwap(p)})", False, "close IS NOT NULL"),
        "ema_50_200_cross_up": lambda p: _cross(p, "ema_50", "ema_200", True, "ema_200 IS NOT NULL"), "ema_50_200_cross_down": lambda p: _cross(p, "ema_50", "ema_200", False, "ema_200 IS NOT NULL"),
        "ema_50_200_cross_side": lambda p: f"{_cross(p, 'ema_50', 'ema_200', True, 'ema_200 IS NOT NULL')} - {_cross(p, 'ema_50', 'ema_200', False, 'ema_200 IS NOT NULL')}",
        "abc_macro_regime_score": lambda p: _macro_score(p), "abc_macro_regime_state": lambda p: f"CASE WHEN {p.level(_macro_score(p))} >= 4 THEN 2e0 WHEN {p.level(_macro_score(p))} >= 3 THEN 1e0 ELSE 0e0 END",
        "price_to_vwap_pct": lambda p: _position(_vwap(p)), "price_to_vwap_ratio": lambda p: _or(clip(f"(close / nullif({_vwap(p)}, 0))", "2e-1", "5"), "1"), "volume_ratio": _volume_ratio, "dmi_dir_200": lambda p: _or(clip("((plus_di_200 - minus_di_200) / nullif(plus_di_200 + minus_di_200, 0))", "-1", "1"), "0"),
        "macdext_atr_norm": lambda p: _over_atr(f"({_macdext(p)} / close)"), "macdext_signal_atr_norm": lambda p: _over_atr(f"({p.mean(_macdext(p), 9)} / close)"), "macdext_histogram_atr_norm": lambda p: _over_atr(f"(({_macdext(p)} - {p.mean(_macdext(p), 9)}) / close)"),
        "macdfix_atr_norm": lambda p: _over_atr("(macdfix / close)"), "macdfix_signal_atr_norm": lambda p: _over_atr("(macdfix_signal / close)"), "macdfix_histogram_atr_norm": lambda p: _over_atr("((macdfix - macdfix_signal) / close)"),
    },
    "fx182_box_structure": {
        **{name: _box_part(name, n) for n in WIDTHS for name in (f"box_{k}_{n}" for k in ("hi", "lo", "width_pct", "pos", "stability", "touches_hi", "touches_lo"))},
        "box_compression_score": lambda p: _or(clip(f"({p.level(_box(p, 60)['box_width_pct_60'])} / nullif({p.level(_box(p, 240)['box_width_pct_240'])}, 0))", "0", "10"), "1"), "box_regime_label": _regime,
        "box_breakout_up": lambda p: _breakout(p, "box_hi_120", ">"), "box_breakout_down": lambda p: _breakout(p, "box_lo_120", "<"), "box_prior_trend_sign": lambda p: f"coalesce({p.line('regr_r2', 'close', 60)} * CASE WHEN {p.clock} < 60 THEN NULL WHEN close >= {p.lag('close', 59)} THEN 1 ELSE -1 END, 0)",
    },
    "ta06_to_ta28_recursive": {x: (lambda p, x=x: x) for x in ("rsi", "cmo", "atr", "macd", "macd_signal", "macdfix", "macdfix_signal", "plus_di_200", "minus_di_200", "ema_50", "ema_200")},
    "ta21_to_ta27_oscillators": {
        "ultosc": lambda p: f"100 * ({' + '.join(f'{w} * {p.sum(_pressure(p)[0], n)} / nullif({p.sum(_pressure(p)[1], n)}, 0)' for w, n in ((4, 7), (2, 14), (1, 28)))}) / 7", "stoch_k": lambda p: _stoch(p), "stoch_d": lambda p: p.mean(_stoch(p), 3),
        "stochrsi_k": lambda p: _stochrsi(p), "stochrsi_d": lambda p: p.mean(_stochrsi(p), 3), "macdext": _macdext, "macdext_signal": lambda p: p.mean(_macdext(p), 9), "macdext_histogram": lambda p: f"{_macdext(p)} - {p.mean(_macdext(p), 9)}",
        "bb_upper": lambda p: f"{_band(p)[0]} + 2 * {_band(p)[1]}", "bb_middle": lambda p: _band(p)[0], "bb_lower": lambda p: f"{_band(p)[0]} - 2 * {_band(p)[1]}",
    },
    "fx186_fx187_sessions": {
        "session_id": lambda p: "CASE WHEN hour(ts) < 8 THEN 0e0 WHEN hour(ts) < 14 THEN 1e0 WHEN hour(ts) < 21 THEN 2e0 ELSE 3e0 END", "hour_sin": lambda p: "sin(2 * pi() * hour(ts) / 24)", "hour_cos": lambda p: "cos(2 * pi() * hour(ts) / 24)", "is_session_overlap": lambda p: "CASE WHEN hour(ts) >= 14 AND hour(ts) < 16 THEN 1e0 ELSE 0e0 END",
        "bars_since_local_high": lambda p: _since(p, "high"), "bars_since_local_low": lambda p: _since(p, "-low"),
    },
}


def _pressure(p: Bars) -> tuple[str, str]:
    """How far the close is above the lowest of low and last close, and the true range."""
    before = p.lag("close", 1)
    low = p.level(f"CASE WHEN {before} IS NOT NULL THEN least(low, {before}) END")
    return p.level(f"close - {low}"), p.level(f"CASE WHEN {before} IS NOT NULL THEN greatest(high, {before}) - {low} END")


def _stoch(p: Bars) -> str:
    lo, hi = p.low("low", 5), p.high("high", 5)
    return p.mean(f"100 * (close - {lo}) / nullif({hi} - {lo}, 0)", 3)


def _stochrsi(p: Bars) -> str:
    lo, hi = p.low("rsi", 5), p.high("rsi", 5)
    return p.level(f"100 * (rsi - {lo}) / nullif({hi} - {lo}, 0)")


def _weekday(p: Bars) -> str:
    """0 is Monday, of the calendar in Shanghai."""
    shifted = "ts + INTERVAL 8 HOUR"
    return f"weekday({shifted})" if p.dialect == "spark" else f"(isodow({shifted}) - 1)"


def _signs(p: Bars) -> list[str]:
    return [p.level(f"coalesce(sign({p.change('close', n)}), 0e0)") for n in (3, 5, 10)]


def _jump(p: Bars) -> str:
    """The largest move over the deviation of the 10 bars before."""
    r = p.level(_or(p.change("close"), "0"))
    sd, most = p.lag(p.some("stddev_samp", r, 10, 10), 1), p.lag(p.some("max", f"abs({r})", 10, 10), 1)
    return p.level(f"CASE WHEN {sd} > 1e-9 THEN {most} / {sd} END")


def _duration(p: Bars) -> str:
    return f"least({p.run(f'coalesce({_atr_share(p)}, 0) <= 2e-1')} / 540, 1)"


def _memory(p: Bars) -> str:
    """m = max(s, 0.97 m): 0.97^t times the running maximum of s / 0.97^t, in logarithms."""
    s, t = p.level(f"greatest(0, (2e-1 - coalesce({_atr_share(p)}, 5e-1)) / 2e-1)"), p.clock
    top = p.so_far("max", f"CASE WHEN {s} > 0 THEN ln({s}) - {t} * ln(97e-2) END")
    return f"CASE WHEN {top} IS NOT NULL THEN least(exp({top} + {t} * ln(97e-2)), 1) ELSE 0 END"


def _cvd(p: Bars) -> str:
    return p.so_far("sum", "buy_qty - sell_qty")


def _decoupling(p: Bars, n: int = 60) -> str:
    """How closely changes of signed volume and log returns move together, whatever the sign."""
    d, r, w = p.level(f"coalesce({p.delta(_cvd(p), 1)}, 0)"), p.level(f"coalesce(ln(close / {p.lag('close', 1)}), 0)"), p.frame(n)
    value = f"covar_pop({d}, {r}) OVER {w} / nullif(stddev_pop({d}) OVER {w} * stddev_pop({r}) OVER {w}, 0)"
    return p.level(_or(clip(p.level(f"abs(CASE WHEN {p.clock} >= {max(n // 2, 10)} THEN {value} END)"), "0", "1"), "0"))


def _vwap(p: Bars) -> str:
    return p.level(f"{p.some('sum', 'close * volume', 20)} / nullif({p.some('sum', 'volume', 20)}, 0)")


def _macro_score(p: Bars) -> str:
    """Funding counts as 0 where none is given, which supports."""
    at, slope = p.level(_position("ema_1200")), p.level(f"coalesce({p.delta('ema_1200', 10)} / nullif(ema_1200, 0), 0)")
    tests = (f"{at} >= 2e-2", f"{slope} >= 0", f"{at} >= 8e-2", f"coalesce({_atr_percentile(p)}, 0) >= 35e-2")
    return " + ".join(f"CASE WHEN {t} THEN 1e0 ELSE 0e0 END" for t in tests) + " + 1e0"


def _since(p: Bars, x: str) -> str:
    """Bars since the first extreme of the last 20, over 50."""
    x = p.level(x)
    values = p.add(p._list(x, 20))
    if p.dialect == "spark":
        return f"least((size({values}) - array_position({values}, array_max({values}))) / 50e0, 1)"
    return f"least((len({values}) - list_position({values}, list_max({values}))) / 50e0, 1)"


def _ratio(a: str, b: str) -> str:
    return f"({a} - {b}) / ({a} + {b} + 1e-10)"


def _means(name: str, x: str) -> dict[str, Callable[[Bars], str]]:
    return {f"{name}_ma{n}": (lambda p, n=n: p.some("avg", x, n)) for n in (5, 10, 20)}


def _zs(name: str, x: str) -> dict[str, Callable[[Bars], str]]:
    return {f"{name}_zscore_{n}": (lambda p, n=n: p.soft_z(x, n)) for n in (20, 50)}


def _spike(p: Bars, n: int) -> str:
    """Above the frame's median by two median absolute deviations."""
    values = p.add(p._list("vpin", n))
    if p.dialect == "spark":
        m = p.add(f"percentile(vpin, 5e-1) OVER {p.frame(n)}")
        away = p.level(f"array_sort(transform({values}, q -> abs(q - {m})))")
        mad = f"({away}[CAST((size({away}) - 1) DIV 2 AS INT)] + {away}[CAST(size({away}) DIV 2 AS INT)]) / 2"
    else:
        m = p.add(f"median(vpin) OVER {p.frame(n)}")
        mad = f"list_median(list_transform({values}, lambda q: abs(q - {m})))"
    return f"CASE WHEN {p.near('vpin', 12)} > {p.near(f'({m} + 2 * {mad})', 12)} THEN 1 ELSE 0 END"


def _mean_rank(p: Bars, n: int) -> str:
    """Percentile of the last value in its frame: the mean of the shares below and at most it."""
    x = p.level(p.near("vpin", 12))
    values = p.add(p._list(x, n))
    size, keep, arrow = ("size", "filter", "q -> q") if p.dialect == "spark" else ("len", "list_filter", "lambda q: q")
    return f"CASE WHEN {x} IS NOT NULL THEN ({size}({keep}({values}, {arrow} < {x})) + {size}({keep}({values}, {arrow} <= {x}))) / (2e0 * {size}({values})) END"


def _intensity(p: Bars) -> str:
    total = p.level("coalesce(buy_run_count, 0) + coalesce(sell_run_count, 0)")
    active = clip(f"({total} / ({p.some('avg', total, 20, 5)} + 1e-8))", "0", "3")
    flow = f"least(6e-1 * abs((coalesce(buy_run_count, 0) - coalesce(sell_run_count, 0)) / ({total} + 1e-8)) + 4e-1 * abs(coalesce(imbalance_ratio, 0)), 1)"
    return p.level(f"least({flow} * (1 - least(greatest(coalesce(directional_entropy, 1), 0), 1)) * coalesce({active} / 3, 0), 1)")


def _moved(p: Bars) -> str:
    return p.level("least(coalesce((high - low) / greatest(coalesce(atr, 1e-8), 1e-8), 0) / 5e-1, 1)")


_NET, _TOTAL = "(buy_run_count - sell_run_count)", "(buy_run_count + sell_run_count)"
#: Over the columns of bars.with_flow.
FLOW_FEATURES: dict[str, dict[str, Callable[[Bars], str]]] = {
    "fx074_fx076_to_fx083_vpin": {
        "ofi_short": lambda p: _or(p.some("avg", "vpin_signed_imbalance", 5), "0"), **_means("vpin", "vpin"), **{f"vpin_max{n}": (lambda p, n=n: p.some("max", "vpin", n)) for n in (5, 10, 20)}, "vpin_change": lambda p: p.delta("vpin", 1), "vpin_change_pct": lambda p: f"{p.delta('vpin', 1)} / ({p.lag('vpin', 1)} + 1e-9)",
        **_zs("vpin", "vpin"), **{f"vpin_quantile_rank_{n}": (lambda p, n=n: _mean_rank(p, n)) for n in (20, 50)}, **{f"vpin_volatility_{n}": (lambda p, n=n: p.some("stddev_samp", "vpin", n)) for n in (10, 20)}, **{f"vpin_spike_flag_{n}": (lambda p, n=n: _spike(p, n)) for n in (20, 50)},
        "vpin_momentum": lambda p: f"{p.some('avg', 'vpin', 5)} - {p.some('avg', 'vpin', 20)}", **_zs("vpin_signed_imbalance", "vpin_signed_imbalance"),
    },
    "fx084_fx086_to_fx106_trade_clusters": {
        "trade_cluster_flow_intensity": _intensity, "trade_cluster_absorption_score": lambda p: f"{_intensity(p)} * {_moved(p)}", "trade_cluster_exhaustion_score": lambda p: f"{_intensity(p)} * (1 - {_moved(p)})",
        **{f"trade_cluster_{x}": (lambda p, x=x: x) for x in ("max_buy_run", "max_sell_run", "avg_buy_run", "avg_sell_run", "buy_run_count", "sell_run_count", "imbalance_ratio", "directional_entropy")},
        "trade_cluster_max_run_ratio": lambda p: _ratio("max_buy_run", "max_sell_run"), "trade_cluster_max_run": lambda p: "greatest(max_buy_run, max_sell_run)", "trade_cluster_buy_sell_max_ratio": lambda p: "max_buy_run / (max_sell_run + 1e-10)", "trade_cluster_avg_run_ratio": lambda p: _ratio("avg_buy_run", "avg_sell_run"), "trade_cluster_buy_sell_avg_ratio": lambda p: "avg_buy_run / (avg_sell_run + 1e-10)",
        "trade_cluster_total_run_length": lambda p: "avg_buy_run * buy_run_count + avg_sell_run * sell_run_count", "trade_cluster_avg_run_length": lambda p: f"(avg_buy_run * buy_run_count + avg_sell_run * sell_run_count) / ({_TOTAL} + 1e-10)", "trade_cluster_net_runs": lambda p: _NET, "trade_cluster_total_runs": lambda p: _TOTAL, "trade_cluster_net_runs_ratio": lambda p: clip(f"({_NET} / ({_TOTAL} + 1e-10))", "-1", "1"),
        **_means("trade_cluster_directional_entropy", "directional_entropy"), "trade_cluster_directional_entropy_change": lambda p: p.delta("directional_entropy", 1), **_zs("trade_cluster_directional_entropy", "directional_entropy"), **_means("trade_cluster_max_buy_run", "max_buy_run"), **_means("trade_cluster_imbalance_ratio", "imbalance_ratio"), **_means("trade_cluster_net_runs", _NET), **_means("trade_cluster_total_runs", _TOTAL),
        **_zs("trade_cluster_imbalance", "imbalance_ratio"), **_zs("trade_cluster_net_runs", _NET), **_zs("trade_cluster_max_buy_run", "max_buy_run"), **_zs("trade_cluster_max_sell_run", "max_sell_run"),
    },
    "fx070_fx071_order_flow_crowding": {"ofci_bar": lambda p: "ofci", "ofci_pct": lambda p: p.percent("ofci")},
    "fx139_to_fx147_flow_products": {
        "vpin_x_compression": lambda p: f"coalesce(vpin, 0) / (1 + coalesce(4 * {_band(p)[1]} / nullif({_band(p)[0]}, 0), 0))", "vpin_x_wick_upper": lambda p: "coalesce(vpin, 0) * coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0)", "vpin_x_wick_lower": lambda p: "coalesce(vpin, 0) * coalesce((least(open, close) - low) / nullif(high - low, 0), 0)",
        "vpin_x_trade_cluster_max_buy_run": lambda p: "coalesce(vpin, 0) * coalesce(max_buy_run, 0)", "vpin_zscore_x_trade_cluster_max_buy_run": lambda p: f"coalesce({p.soft_z('vpin', 50)}, 0) * coalesce(max_buy_run, 0)", "vpin_signed_imbalance_x_trade_cluster_imbalance": lambda p: "coalesce(vpin_signed_imbalance, 0) * coalesce(imbalance_ratio, 0)", "vpin_x_trade_cluster_entropy": lambda p: "coalesce(vpin, 0) * coalesce(directional_entropy, 0)",
    },
}


def _energy(p: Bars) -> str:
    return p.level(_signed_log(p.level(f"coalesce(wpt_energy_cascade / nullif({_width_ratio(p)}, 0), 0)")))


#: Over bars with the columns of the wavelet, void and profile kernels.
KERNEL_FEATURES: dict[str, dict[str, Callable[[Bars], str]]] = {
    "fx035_fx051_wavelet_scenes": {
        "compression_energy": lambda p: _or(clip(p.z(_energy(p), 50, 10), "-5", "5"), "0"),
        "wpt_compression_score": lambda p: f"{_squeezed(p)} * {_unit('wpt_multi_scale_consistency')} * (1 - {_unit('wpt_breakout_confidence')})", "wpt_ignition_score": lambda p: f"{_unit('wpt_breakout_confidence')} * (1 - {_unit('wpt_false_breakout_risk')})",
        "wpt_absorption_score": lambda p: f"{_unit('wpt_breakout_confidence')} * (1 - {_unit('wpt_false_breakout_risk')}) * {_unit('(coalesce(wpt_energy_cascade, 0) + 1) / 2')}", "wpt_exhaustion_score": lambda p: f"{_unit('wpt_false_breakout_risk')} * (1 - {_trend(p)})",
    },
    "fx054_profile_scenes": {
        "vp_compression_score": lambda p: f"(1 - {_unit('vp_width_ratio')}) * (1 - {_unit('vp_entropy / 2')})", "vp_ignition_score": lambda p: f"{_unit('vp_poc_deviation / 2')} * {_unit('vp_lv_ratio')}",
        "vp_absorption_score": lambda p: f"(1 - {_unit('vp_entropy / 2')}) * {_unit('vp_width_ratio')} * {_trend(p)}", "vp_exhaustion_score": lambda p: f"{_unit('vp_hv_ratio')} * (1 - {_trend(p)})",
    },
    # void_retracement and void_risk read the bars after: what is made of them is a label
    "fx052_void_scenes": {
        "liquidity_void_compression_score": lambda p: f"{_unit('liquidity_void_speed / 3')} * {_squeezed(p)}",
        "label_void_ignition_score": lambda p: f"{_unit('liquidity_void_speed / 3')} * {_unit('liquidity_void_price_impact / 3')} * (1 - {_unit('void_risk')}) * {_unit('wpt_breakout_confidence')}",
        "label_void_absorption_score": lambda p: f"{_unit('liquidity_void_speed / 3')} * (1 - {_unit('void_retracement')}) * (1 - {_unit('void_risk')}) * {_trend(p)}",
        "label_void_exhaustion_score": lambda p: f"{_unit('liquidity_void_speed / 3')} * {_unit('void_retracement')} * {_unit('void_risk')} * (1 - {_trend(p)})",
    },
}


def with_features(bars: DataFrame, names: dict[str, Callable[[Bars], str]], ties: bool = False) -> DataFrame:
    """symbol, ts and the features; bars must have the columns that they use."""
    p = Bars("spark", ties)
    made = {n: f(p) for n, f in names.items()}
    rows = bars
    for group in batches(p):
        rows = rows.selectExpr("*", *(f"{x} AS {name}" for name, x in group))
    return rows.selectExpr("symbol", "ts", *(f"{x} AS {n}" for n, x in made.items()))


def as_sql(names: dict[str, Callable[[Bars], str]], source: str, ties: bool = False) -> str:
    """The same for DuckDB: what follows the CTEs that make `source`."""
    p = Bars("duckdb", ties)
    made = {n: f(p) for n, f in names.items()}
    ctes, last = "", source
    for k, group in enumerate(batches(p)):
        ctes += f", l{k} AS (SELECT *, {', '.join(f'{x} AS {name}' for name, x in group)} FROM {last})"
        last = f"l{k}"
    return f"{ctes} SELECT symbol, ts, {', '.join(f'{x} AS {n}' for n, x in made.items())} FROM {last}"
