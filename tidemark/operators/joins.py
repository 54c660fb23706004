"""Joins in time: as-of, interval and point-in-time forms without theta joins over the large side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], right_tie: str | None = None, tolerance: str | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before it.

    Both sides are stacked and sorted once by key and time, right rows first at equal
    times; the last right row seen is carried forward. `tolerance` (an interval) drops
    values that are older. A `by` of [] makes one timeline: give such right sides a day or
    month key instead where they are large.
    """
    stamp = F.struct(*(F.col(v).alias(v) for v in values), F.col(right_ts).alias("_at"))
    shape = left.select(F.struct(*left.columns).alias("row")).schema["row"].dataType
    tie = F.col(right_tie).cast("long") if right_tie else F.lit(0).cast("long")
    r = right.select(*by, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), tie.alias("_tie"), stamp.alias("_value"), F.lit(None).cast(shape).alias("_row"))
    none = F.lit(None).cast(r.schema["_value"].dataType)
    keys = [F.col(k) for k in by]
    at = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), none.alias("_value"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = r.unionByName(at).withColumn("_value", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.col("_value._at") + F.expr(f"INTERVAL {tolerance}") >= F.col("_ts") if tolerance else F.lit(True)
    return seen.select("_row.*", *(F.when(fresh, F.col(f"_value.{v}")).alias(v) for v in values))


def asof_one_series(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, values: list[str], right_tie: str) -> DataFrame:
    """As asof, where all left rows look at one series: by day, with the series' last row of earlier days carried to each day.

    Only a table with one row a day is ordered as a whole.
    """
    r = right.withColumn("_day", F.to_date(right_ts))
    last = r.groupBy("_day").agg(F.max_by(F.struct(*values, right_ts, right_tie), F.struct(right_ts, right_tie)).alias("_last"))
    days = left.select(F.to_date(left_ts).alias("_day")).distinct().join(last, "_day", "full_outer")
    w = Window.partitionBy(F.lit(1)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    carried = days.select("_day", F.last("_last", ignorenulls=True).over(w).alias("_last")).where("_last IS NOT NULL").select("_day", "_last.*")
    both = r.select("_day", *values, right_ts, right_tie).unionByName(carried)
    return asof(left.withColumn("_day", F.to_date(left_ts)), both, ["_day"], left_ts, right_ts, values, right_tie).drop("_day")


def in_blocks(rows: DataFrame, ts: str, tie: str, warm: int, block: int = 100_000) -> DataFrame:
    """One series cut into blocks of `block` rows, each with the `warm` rows before it: _n (place in the series), _block, _own.

    Places come from counts of days and places within them, so nothing orders the whole series.
    """
    day = rows.withColumn("_day", F.to_date(ts))
    counts = day.groupBy("_day").agg(F.count("*").alias("_rows"))
    w = Window.partitionBy(F.lit(1)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    starts = counts.select("_day", F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_start"))
    n = day.join(starts, "_day").withColumn("_n", F.col("_start") + F.row_number().over(Window.partitionBy("_day").orderBy(ts, tie)) - 1).drop("_day", "_start")
    own = F.floor(F.col("_n") / block)
    dealt = n.withColumn("_block", F.explode(F.sequence(own, F.floor((F.col("_n") + warm) / block))))
    return dealt.withColumn("_own", F.col("_block") == own)


def interval_sum(spans: DataFrame, points: DataFrame, start: str, end: str, point_ts: str, value: str, out: str) -> DataFrame:
    """Per span the sum of values at points in (start, end].

    Days are the equi-join key: spans are laid out over the days they touch, so no span
    meets a point of another day.
    """
    days = spans.withColumn("_day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))
    p = points.select(F.to_date(point_ts).alias("_day"), F.col(point_ts).alias("_p"), F.col(value).alias("_v"))
    hit = (F.col("_p") > F.col(start)) & (F.col("_p") <= F.col(end))
    met = days.join(p, "_day", "left").groupBy(*spans.columns).agg(F.sum(F.when(hit, F.col("_v"))).alias(out))
    return met.withColumn(out, F.coalesce(out, F.lit(0.0)))


def in_segments(rows: DataFrame, segments: DataFrame, day: Column) -> DataFrame:
    """Rows with the calendar segment of their day; the calendar is a small dimension."""
    s = F.broadcast(segments)  # a handful of date ranges
    return rows.join(s, (s["start_date"] <= day) & (day <= s["end_date"])).drop("start_date", "end_date")


def event_window(bars: DataFrame, events: DataFrame, day: Column, event_day: str, hold: int, size: str) -> DataFrame:
    """Whether a bar lies in an event's days D+1 to D+hold, days since the latest such event, and log of its size."""
    known = events.select(F.explode(F.sequence(F.date_add(event_day, 1), F.date_add(event_day, hold))).alias("_day"), F.col(event_day).alias("_event"), F.col(size).alias("_size"))
    latest = known.groupBy("_day").agg(F.max("_event").alias("_event"), F.max_by("_size", "_event").alias("_size"))
    out = bars.withColumn("_day", day).join(latest, "_day", "left")
    return out.withColumns({"in_window": F.col("_event").isNotNull().cast("int"), "days_since": F.datediff("_day", "_event"), "log_size": F.log1p("_size")}).drop("_day", "_event", "_size")


def anchor_return(bars: DataFrame, anchor: str, close: str = "close") -> DataFrame:
    """The anchor symbol's return of its bar before, on the bars of all symbols."""
    w = Window.partitionBy("symbol").orderBy("ts")
    back = F.col(close) / F.lag(close).over(w) - 1
    a = bars.where(F.col("symbol") == anchor).select("symbol", "ts", back.alias("ret"))
    a = a.select("ts", F.lag("ret").over(w).alias("anchor_return"))
    return bars.join(a, "ts", "left")


def membership(rows: DataFrame, snapshot: DataFrame, on: list[str], present: bool = True) -> DataFrame:
    return rows.join(snapshot.select(*on).distinct(), on, "left_semi" if present else "left_anti")


def merged(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join in which the left side's values win and unmatched rows of both stay."""
    r = right.select(*on, *(F.col(c).alias("_r_" + c) for c in right.columns if c not in on))
    both = left.join(r, on, "full_outer")
    shared = [c for c in left.columns if c not in on and "_r_" + c in r.columns]
    only = [c[3:] for c in r.columns if c.startswith("_r_") and c[3:] not in left.columns]
    return both.select(*on, *(F.coalesce(c, "_r_" + c).alias(c) if c in shared else F.col(c) for c in left.columns if c not in on), *(F.col("_r_" + c).alias(c) for c in only))
