"""A second clock: weeks with their own recursive means, which bars see once the week is over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import recursive
from tidemark.functions.frames import Frames
from tidemark.operators import bars, joins

BY_WEEK = Frames(("symbol",), ("week_end",))


class Means:
    """Exponential means of the values so far, each seeded by the first value and unknown before it has `span` values."""

    def __init__(self, spans: tuple[int, ...]):
        self.spans, self.means, self.n = spans, [recursive.Smooth(1, 2.0 / (s + 1)) for s in spans], 0

    def step(self, x: float) -> tuple[float, ...]:
        self.n += 1
        now = [m.step(x) for m in self.means]
        return tuple(v if self.n >= s else float("nan") for v, s in zip(now, self.spans))


def with_means(weeks: DataFrame, spans: tuple[int, ...] = (50, 200)) -> DataFrame:
    """Weeks of bars.weekly with ema_<span> of their closes; null before there are `span` weeks."""
    names = [f"ema_{s}" for s in spans]
    found = recursive.sequential(weeks, ["symbol"], ["week_end"], ["close"], lambda: Means(spans).step, ", ".join(f"{x} double" for x in names))
    return found.withColumns({x: F.nanvl(x, F.lit(None).cast("double")) for x in names})


def _for_weeks(condition: Column, n: int) -> Column:
    """Whether a condition has held in each of the last n weeks; unknown counts as not."""
    w = BY_WEEK.past(n)
    return (F.sum(F.coalesce(condition, F.lit(False)).cast("int")).over(w) == n).cast("double")


def cycle_exit(weeks: DataFrame, mean: str = "ema_50", below: int = 2, falling: int = 2) -> DataFrame:
    """Weeks with two flags and both together: closes under the mean in `below` weeks, lower highs and lower lows in `falling` weeks."""
    lower = (F.col("high") < BY_WEEK.lag("high")) & (F.col("low") < BY_WEEK.lag("low"))
    flagged = weeks.withColumns({"_under": F.col("close") < F.col(mean), "_lower": lower})
    flagged = flagged.withColumns({"weekly_close_below": _for_weeks(F.col("_under"), below), "weekly_lower_high_lower_low": _for_weeks(F.col("_lower"), falling)}).drop("_under", "_lower")
    return flagged.withColumn("weekly_macro_cycle_exit_signal", F.col("weekly_close_below") * F.col("weekly_lower_high_lower_low"))


def on_bars(rows: DataFrame, weeks: DataFrame, values: list[str]) -> DataFrame:
    """Each bar with the values of the last week that was over at its start, on the Monday after its Sunday: no bar sees its own week."""
    known = weeks.withColumn("known_at", F.date_add("week_end", 1).cast("timestamp"))
    return joins.asof(rows, known, ["symbol"], "ts", "known_at", values)


def positions(rows: DataFrame, spans: tuple[int, ...] = (50, 200), below: int = 2, falling: int = 2) -> DataFrame:
    """symbol, ts, weekly_ema_<span>_position ((close - mean) / close, -1 to 1, null without a mean) and the flags of cycle_exit (0 before the first week)."""
    weeks = cycle_exit(with_means(bars.weekly(rows), spans), f"ema_{spans[0]}", below, falling)
    flags = ["weekly_close_below", "weekly_lower_high_lower_low", "weekly_macro_cycle_exit_signal"]
    seen = on_bars(rows.select("symbol", "ts", "close"), weeks, [*(f"ema_{s}" for s in spans), *flags])
    away = {f"weekly_ema_{s}_position": F.when((F.col("close") != 0) & F.col(f"ema_{s}").isNotNull(), F.greatest(F.least((F.col("close") - F.col(f"ema_{s}")) / F.col("close"), F.lit(1.0)), F.lit(-1.0))) for s in spans}
    return seen.withColumns(away).select("symbol", "ts", *away, *(F.coalesce(x, F.lit(0.0)).alias(x) for x in flags))
