"""Normalisation, filling, clipping and reports on data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Frames, correlation


def normalized(rows: DataFrame, columns: list[str], by: list[str], method: str = "zscore") -> DataFrame:
    """Each column against its key's statistics: zscore (population deviation, clipped to 3), minmax, or robust (1 to 99 %); null becomes 0."""
    w = Window.partitionBy(*by)

    def one(c):
        if method == "zscore":
            sd = F.stddev_pop(c).over(w)
            v = F.least(F.greatest(F.when(sd > 0, (F.col(c) - F.avg(c).over(w)) / sd), F.lit(-3.0)), F.lit(3.0))
        else:
            q = (0.0, 1.0) if method == "minmax" else (0.01, 0.99)
            lo, hi = (F.percentile(c, F.lit(x)).over(w) for x in q)
            v = F.least(F.greatest(F.when(hi > lo, (F.col(c) - lo) / (hi - lo)), F.lit(0.0)), F.lit(1.0))
        return F.when(F.col(c).isNull(), 0.0).otherwise(F.coalesce(v, F.lit(0.0)))

    return rows.withColumns({c + "_norm": one(c) for c in columns})


def statistics(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """A table to fit once and apply later: column, mean, sd, lowest, highest per key."""
    return rows.unpivot(by, columns, "column", "x").groupBy(*by, "column").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lowest"), F.max("x").alias("highest"))


def applied(rows: DataFrame, fitted: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Columns standardised by a stored table."""
    wide = fitted.groupBy(*by).pivot("column", columns).agg(F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    out = rows.join(wide, by, "left")
    made = {c + "_std": F.when(F.col(c + "_sd") > 0, (F.col(c) - F.col(c + "_mean")) / F.col(c + "_sd")) for c in columns}
    return out.withColumns(made).drop(*(c + x for c in columns for x in ("_mean", "_sd")))


def filled(rows: DataFrame, column: str, frames: Frames, method: str = "ffill") -> DataFrame:
    w = Window.partitionBy(*frames.keys)
    ahead = frames.ordered.rowsBetween(0, Window.unboundedFollowing)
    value = {
        "ffill": lambda: frames.filled(column), "bfill": lambda: F.first(column, ignorenulls=True).over(ahead), "zero": lambda: F.lit(0.0),
        "mean": lambda: F.avg(column).over(w), "median": lambda: F.percentile(column, F.lit(0.5)).over(w),
    }[method]()
    return rows.withColumn(column, F.coalesce(F.col(column), value))


def clipped(rows: DataFrame, column: str, by: list[str], method: str = "std", k: float = 3.0) -> DataFrame:
    """Values brought inside mean +- k sd, the k to 1 - k quantiles, or the quartiles +- k times their distance."""
    w = Window.partitionBy(*by)
    q = lambda x: F.percentile(column, F.lit(x)).over(w)
    if method == "std":
        lo, hi = (F.avg(column).over(w) + s * k * F.stddev_samp(column).over(w) for s in (-1, 1))
    elif method == "quantile":
        lo, hi = q(k), q(1 - k)
    else:
        lo, hi = q(0.25) - k * (q(0.75) - q(0.25)), q(0.75) + k * (q(0.75) - q(0.25))
    return rows.withColumn(column, F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), lo), hi)))


def finite(column: str):
    """Null for infinities; NaN stays what it is."""
    return F.when(F.abs(column) == float("inf"), None).otherwise(F.col(column))


def report(rows: DataFrame, columns: list[str], k: float = 5.0, high: float = 0.5) -> DataFrame:
    """column, issue, count, share: nulls, NaN, infinities, values beyond k deviations, constant columns. Two passes, whatever the number of columns."""
    usable = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in columns}
    stats = rows.agg(*(f(v).alias(n + c) for c, v in usable.items() for n, f in (("m_", F.avg), ("s_", F.stddev_samp))))
    wide = rows.crossJoin(F.broadcast(stats)).agg(  # one row of statistics
        F.count("*").alias("n"),
        *(x for c, v in usable.items() for x in (
            F.count(F.when(F.col(c).isNull(), 1)).alias("null_" + c), F.count(F.when(F.isnan(c), 1)).alias("nan_" + c), F.count(F.when(F.abs(c) == float("inf"), 1)).alias("inf_" + c),
            F.count(F.when(F.abs(v - F.col("m_" + c)) > k * F.col("s_" + c), 1)).alias("outlier_" + c), F.when(F.coalesce(F.max(v) == F.min(v), F.lit(False)), F.count(v)).otherwise(0).alias("constant_" + c))),
    )
    issues = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(i).alias("issue"), F.col(f"{i}_{c}").alias("count")) for c in columns for i in ("null", "nan", "inf", "outlier", "constant")))
    out = wide.select("n", F.explode(issues).alias("x")).select("x.column", "x.issue", "x.count", F.when(F.col("n") > 0, F.col("x.count") / F.col("n")).alias("share"))
    return out.where("count > 0").withColumn("high", F.col("share") > high)


def leakage(rows: DataFrame, columns: list[str], frames: Frames, ret: str, shift: int = 1) -> DataFrame:
    """Per column the correlation with the next return, and with the past one; suspect where the future is better known by far."""
    ahead = rows.withColumns({"_f": frames.lead(ret, shift), "_p": frames.lag(ret, shift)})
    long = ahead.unpivot(["_f", "_p"], columns, "column", "x")
    out = long.groupBy("column").agg(correlation("x", "_f").alias("future_corr"), correlation("x", "_p").alias("past_corr"))
    return out.withColumn("suspect", (F.abs("future_corr") > 0.5) | (F.abs("future_corr") > F.abs("past_corr") + 0.3))


def missing(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return expected.select(*on).distinct().join(present.select(*on).distinct(), on, "left_anti")


def chained(rows: DataFrame, *steps) -> DataFrame:
    return reduce(lambda df, f: df.transform(f), steps, rows)


def categories(rows: DataFrame, column: str) -> DataFrame:
    """Codes from 0 in order of the values, with counts; one row a value."""
    values = rows.where(F.col(column).isNotNull()).groupBy(column).count()
    return values.select(column, (F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(column)) - 1).alias("code"), "count")
