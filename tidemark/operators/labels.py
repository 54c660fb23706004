"""Labels: what a row's future path does first. They read the future and are never features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import Frames


def _first(path: Column, hit) -> Column:
    """1-based place of the first struct of a path for which hit holds, or null."""
    places = F.filter(F.transform(path, lambda x, i: F.when(hit(x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(places) > 0, F.array_min(places))


def with_path(bars: DataFrame, frames: Frames, horizon: int, offset: int = 1) -> DataFrame:
    return bars.withColumn("_path", F.collect_list(F.struct("high", "low")).over(frames.ahead(horizon, offset)))


def risk_reward(bars: DataFrame, frames: Frames, atr: str = "atr", r: float = 2.0, stop: float = 1.0, horizon: int = 24) -> DataFrame:
    """1 if a long entered at the next open makes r * ATR before it loses stop * ATR within the horizon, else 0; the same bar is a failure. mfe and mae in ATR."""
    rows = with_path(bars, frames, horizon).withColumn("_entry", frames.lead("open"))
    up, down = F.col("_entry") + r * F.col(atr), F.col("_entry") - stop * F.col(atr)
    tp, sl = _first(F.col("_path"), lambda x: x["high"] >= up), _first(F.col("_path"), lambda x: x["low"] <= down)
    known = F.col("_entry").isNotNull() & (F.size("_path") == horizon) & (F.col(atr) > 0)
    extreme = lambda f, c: f(F.transform("_path", lambda x: x[c]))
    return rows.withColumns({
        "tp_bar": F.when(known, tp), "sl_bar": F.when(known, sl),
        "rr_label": F.when(known, F.when(tp.isNotNull() & (sl.isNull() | (tp < sl)), 1).otherwise(0)),
        "mfe": F.when(known, (extreme(F.array_max, "high") - F.col("_entry")) / F.col(atr)), "mae": F.when(known, (F.col("_entry") - extreme(F.array_min, "low")) / F.col(atr)),
    }).drop("_path", "_entry")


def triple_barrier(bars: DataFrame, frames: Frames, atr: str = "atr", up: float = 1.0, down: float = 1.0, horizon: int = 12) -> DataFrame:
    """+1, -1 or 0 by the barrier that is touched first; a tie goes to the stop; the last `horizon` rows are null."""
    rows = with_path(bars, frames, horizon)
    tp = _first(F.col("_path"), lambda x: x["high"] >= F.col("close") + up * F.col(atr))
    sl = _first(F.col("_path"), lambda x: x["low"] <= F.col("close") - down * F.col(atr))
    known = (F.size("_path") == horizon) & F.col(atr).isNotNull()
    side = F.when(sl.isNotNull() & (tp.isNull() | (sl <= tp)), -1).when(tp.isNotNull(), 1).otherwise(0)
    return rows.withColumn("barrier", F.when(known, side)).withColumn("meta", F.when(F.col("barrier").isNotNull(), (F.col("barrier") == 1).cast("int"))).drop("_path")


def forward_volatility(bars: DataFrame, frames: Frames, ret: str, horizon: int) -> DataFrame:
    """Root mean square of the next `horizon` returns, and of the last ones."""
    sq = F.col(ret) * F.col(ret)
    ahead, past = frames.ahead(horizon), frames.past(horizon)
    return bars.withColumns({
        "fwd_vol": F.when(F.count(sq).over(ahead) == horizon, F.sqrt(F.avg(sq).over(ahead))),
        "past_vol": F.when(F.count(sq).over(past) == horizon, F.sqrt(F.avg(sq).over(past))),
    })


def path_extremes(bars: DataFrame, frames: Frames, atr: str, horizon: int, floor: float = -0.8) -> DataFrame:
    """(highest high - close) and (close - lowest low) of the next rows in ATR, their difference, the end-point move and win flags."""
    w = frames.ahead(horizon)
    full = F.count("high").over(w) == horizon
    mfe, mae = (F.max("high").over(w) - F.col("close")) / F.col(atr), (F.col("close") - F.min("low").over(w)) / F.col(atr)
    move = (frames.lead("close", horizon) - F.col("close")) / F.col(atr)
    return bars.withColumns({
        "fwd_mfe": F.when(full, mfe), "fwd_mae": F.when(full, mae), "fwd_rr": F.when(full, mfe - mae), "fwd_move": move,
        "long_win": (move > -floor).cast("int"), "short_win": (move < floor).cast("int"), "log_move": F.signum(move) * F.log1p(F.abs(move)),
        "is_bad": (move < floor).cast("int"), "failure": F.when(full, (mae > 1.2).cast("int")),
    })


def quantile_label(bars: DataFrame, frames: Frames, ret: str, horizon: int, window: int) -> DataFrame:
    """Share of the last `window` known forward returns that are below the current one."""
    fwd = bars.withColumn("fwd_ret", frames.lead("close", horizon) / F.col("close") - 1)
    past = F.collect_list("fwd_ret").over(frames.ordered.rowsBetween(-window - horizon + 1, -horizon))
    return fwd.withColumn("fwd_quantile", F.when((F.size(past) == window) & F.col("fwd_ret").isNotNull(), F.size(F.filter(past, lambda x: x < F.col("fwd_ret"))) / window))


def first_touch(bars: DataFrame, frames: Frames, atr: str, horizon: int, touch: float = 1.0) -> DataFrame:
    """Signed largest excursion in ATR, on the side that is first `touch` away; both in one bar: the larger of that bar; neither: the larger of the path."""
    rows = bars.withColumn("_path", F.collect_list(F.struct("high", "low")).over(frames.ahead(horizon)))
    up, down = (lambda x: (x["high"] - F.col("close")) / F.col(atr)), (lambda x: (F.col("close") - x["low"]) / F.col(atr))
    at = _first(F.col("_path"), lambda x: (up(x) >= touch) | (down(x) >= touch))
    bar = F.element_at("_path", at.cast("int"))
    best_up, best_down = (F.array_max(F.transform("_path", f)) for f in (up, down))
    long = F.when(at.isNull(), best_up >= best_down).when((up(bar) >= touch) & (down(bar) >= touch), up(bar) >= down(bar)).otherwise(up(bar) >= touch)
    known = (F.size("_path") == horizon) & (F.col(atr) > 1e-12)
    return rows.withColumn("first_touch_mfe", F.when(known, F.when(long, best_up).otherwise(-best_down))).drop("_path")


def exits(bars: DataFrame, frames: Frames, atr: str, horizon: int, stop: float, target: float, trail: float | None = None) -> DataFrame:
    """What ends a long that fills at the next open: bars held, reason (stop, target, time), price and R.

    Each bar's stop counts before its target. With `trail`, the stop follows the highest high of the
    bars before at that many ATR. A path shorter than the horizon is unknown.
    """
    rows = bars.withColumn("_path", F.collect_list(F.struct("high", "low", "close")).over(frames.ahead(horizon))).withColumn("_entry", frames.lead("open"))
    entry, size = F.col("_entry"), F.col(atr)
    first = entry - stop * size
    levels = F.transform("_path", lambda x, i: first)
    if trail is not None:
        levels = F.transform("_path", lambda x, i: F.when(i == 0, first).otherwise(F.greatest(first, F.array_max(F.transform(F.slice("_path", 1, F.greatest(i, F.lit(1))), lambda q: q["high"])) - trail * size)))
    rows = rows.withColumn("_steps", F.arrays_zip("_path", levels.alias("level")))
    rows = rows.withColumn("_steps", F.transform("_steps", lambda x: F.struct(x["_path"]["high"].alias("high"), x["_path"]["low"].alias("low"), x["_path"]["close"].alias("close"), x["level"].alias("level"))))
    hit = _first(F.col("_steps"), lambda x: (x["low"] <= x["level"]) | (x["high"] >= entry + target * size))
    known = entry.isNotNull() & (F.size("_path") == horizon) & (size > 0)
    bar = F.element_at("_steps", F.coalesce(hit, F.lit(horizon)).cast("int"))
    reason = F.when(hit.isNull(), "time").when(bar["low"] <= bar["level"], "stop").otherwise("target")
    price = F.when(hit.isNull(), bar["close"]).when(bar["low"] <= bar["level"], bar["level"]).otherwise(entry + target * size)
    rows = rows.withColumns({"held": F.when(known, F.coalesce(hit, F.lit(horizon)).cast("int")), "reason": F.when(known, reason), "exit_price": F.when(known, price)})
    return rows.withColumn("r", (F.col("exit_price") - entry) / (stop * size)).drop("_path", "_entry", "_steps")


def level_reaction(bars: DataFrame, frames: Frames, signal: str, level: str, atr: str, horizon: int = 5, deep: float = 0.5, far: float = 2.0) -> DataFrame:
    """reaction: what the `horizon` bars after a signal (1 long, -1 short, 0 or null none) make of its level.

    breakout: they go through it by `deep` ATR against the signal, or without that `far` ATR
    away with it; reversal: neither. Null without a signal, a level, a positive ATR or the whole horizon.
    """
    w = frames.ahead(horizon)
    side = F.signum(signal)
    above, below = (F.max("high").over(w) - F.col(level)) / F.col(atr), (F.col(level) - F.min("low").over(w)) / F.col(atr)
    against, along = F.when(side > 0, below).otherwise(above), F.when(side > 0, above).otherwise(below)
    known = (F.coalesce(side, F.lit(0)) != 0) & F.col(level).isNotNull() & (F.col(atr) > 0) & (F.count("high").over(w) == horizon)
    return bars.withColumn("reaction", F.when(known, F.when((against > deep) | (along > far), "breakout").otherwise("reversal")))


def by_reaction(bars: DataFrame, label: str, reactions: tuple[str, ...] = ("reversal", "breakout")) -> DataFrame:
    """label_<reaction>: the label where a level was met with that reaction."""
    return bars.withColumns({f"{label}_{x}": F.when(F.col("reaction") == x, F.col(label)) for x in reactions})


def retracement(bars: DataFrame, frames: Frames, flag: str, horizon: int = 3) -> DataFrame:
    """retracement: the larger of the rise and the fall from the close within `horizon` bars after a flagged one, and the risk that its size stands for; 0 elsewhere and where the horizon is cut off."""
    w = frames.ahead(horizon)
    known = (F.col(flag) == 1) & (F.count("close").over(w) == horizon) & (F.col("close") > 0)
    size = F.greatest(F.max("close").over(w) / F.col("close") - 1, 1 - F.min("close").over(w) / F.col("close"))
    rows = bars.withColumn("retracement", F.when(known, size).otherwise(0.0))
    return rows.withColumn("false_breakout_risk", F.when(known, F.when(F.col("retracement") > 0.5, 0.8).when(F.col("retracement") > 0.3, 0.5).otherwise(0.2)).otherwise(0.0))


def realized_r(bars: DataFrame, atr: str, horizon: int, stop: float, target: float, trail: float | None = None, floor: float = 0.0) -> DataFrame:
    """symbol, ts, realized_r_long, realized_r_short, label: what a long and a short from the next open make under one exit profile, and the long less the short.

    A short is a long on prices turned upside down. label is null where it is under `floor` in size, or a side is unknown.
    """
    side = lambda k, high, low: F.struct(F.lit(k).alias("side"), (k * F.col("open")).alias("open"), (k * F.col(high)).alias("high"), (k * F.col(low)).alias("low"), (k * F.col("close")).alias("close"))
    both = bars.select("symbol", "ts", atr, F.inline(F.array(side(1, "high", "low"), side(-1, "low", "high"))))
    found = exits(both, Frames(("symbol", "side"), ("ts",)), atr, horizon, stop, target, trail)
    of = lambda k: F.max(F.when(F.col("side") == k, F.col("r")))
    out = found.groupBy("symbol", "ts").agg(of(1).alias("realized_r_long"), of(-1).alias("realized_r_short"))
    label = F.col("realized_r_long") - F.col("realized_r_short")
    return out.withColumn("label", F.when(F.abs(label) >= floor, label))
