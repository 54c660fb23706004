"""Cross-sections of daily rows: scores, books and their figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Frames, correlation, cross_z
from tidemark.operators.joins import in_segments

BY_DAY = Frames(("symbol",), ("date",))
YEAR = 252


def with_factors(daily: DataFrame, momentum: int = 20, label: int = 20) -> DataFrame:
    """mom, amount_z, book_ret (open to open, entered after the close) and fwd (label)."""
    f = BY_DAY
    return daily.withColumns({
        "mom": f.change("close", momentum), "amount_z": f.zscore("amount", momentum),
        "book_ret": f.lead("open", 2) / f.lead("open", 1) - 1, "fwd": f.lead("open", label + 1) / f.lead("open", 1) - 1,
    })


def with_score(panel: DataFrame) -> DataFrame:
    """Half momentum, half turnover, each as a z-score of the day; rounded, so that equal scores stay equal whatever the order of summing."""
    return panel.withColumn("score", F.round(0.5 * cross_z("mom", "date") + 0.5 * cross_z("amount_z", "date"), 9) + 0.0)


def books(scored: DataFrame, q: float = 0.2, least: int = 10) -> DataFrame:
    """Daily returns of the top and low share by score, a score-weighted book and its inverse, and all names; days with few names go."""
    rows = scored.where("score IS NOT NULL AND book_ret IS NOT NULL")
    day = Window.partitionBy("date")
    rows = rows.withColumns({"hi": F.percentile("score", F.lit(1 - q)).over(day), "lo": F.percentile("score", F.lit(q)).over(day), "n": F.count("*").over(day)}).where(F.col("n") >= least)
    up, down = F.greatest("score", F.lit(0.0)), F.greatest(-F.col("score"), F.lit(0.0))
    weighted = lambda w: F.when(F.sum(w) > 0, F.sum(w * F.col("book_ret")) / F.sum(w))
    return rows.groupBy("date").agg(
        F.avg(F.when(F.col("score") >= F.col("hi"), F.col("book_ret"))).alias("top"), F.avg(F.when(F.col("score") <= F.col("lo"), F.col("book_ret"))).alias("low"),
        weighted(up).alias("weighted"), weighted(down).alias("inverse"), F.avg("book_ret").alias("all_names"), F.count("*").alias("n"),
    ).withColumn("excess", F.col("top") - F.col("all_names"))


def sector_scores(panel: DataFrame, industry: DataFrame, least_names: int = 1, least_sectors: int = 3) -> DataFrame:
    """Mean factors of a sector's names each day and their z across sectors."""
    rows = panel.join(industry, "symbol").where("mom IS NOT NULL AND amount_z IS NOT NULL")
    s = rows.groupBy("date", "industry").agg(F.avg("mom").alias("mom"), F.avg("amount_z").alias("amount_z"), F.avg("book_ret").alias("book_ret"), F.count("*").alias("names")).where(F.col("names") >= least_names)
    s = s.withColumn("sectors", F.count("*").over(Window.partitionBy("date"))).where(F.col("sectors") >= least_sectors)
    return with_score(s)


def turnover(weights: DataFrame, name: str) -> DataFrame:
    """Half the sum of absolute weight changes against the previous day that has weights (date, name, weight)."""
    days = weights.select("date").distinct().groupBy(F.lit(1).alias("k")).agg(F.array_sort(F.collect_set("date")).alias("d"))  # one date a trading day
    step = days.select(F.explode(F.arrays_zip(F.expr("slice(d, 2, size(d))").alias("date"), F.expr("slice(d, 1, size(d) - 1)").alias("earlier"))).alias("x")).select("x.date", "x.earlier")
    step = F.broadcast(step)
    now = weights.join(step, "date").select("date", name, F.col("weight").alias("now"))
    past = weights.withColumnsRenamed({"date": "earlier", "weight": "past"}).join(step, "earlier").select("date", name, "past")
    both = now.join(past, ["date", name], "full_outer")
    return both.groupBy("date").agg((0.5 * F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("past", F.lit(0.0))))).alias("turnover"))


def figures(returns: DataFrame, by: list[str], day: str = "date", ret: str = "ret") -> DataFrame:
    """Days, CAGR, largest drawdown, Calmar and Sharpe ratio of daily returns in each group."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    eq = returns.where(F.col(ret).isNotNull()).withColumn("eq", F.exp(F.sum(F.log1p(ret)).over(w)))
    eq = eq.withColumn("dd", F.col("eq") / F.greatest(F.lit(1.0), F.max("eq").over(w)) - 1)
    out = eq.groupBy(*by).agg(F.count("*").alias("days"), F.max_by("eq", day).alias("last"), F.min("dd").alias("max_drawdown"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s"))
    cagr = F.pow("last", F.lit(YEAR) / F.col("days")) - 1
    return out.select(*by, "days", cagr.alias("cagr"), "max_drawdown", F.when(F.col("max_drawdown") < 0, cagr / -F.col("max_drawdown")).alias("calmar"), F.when((F.col("days") >= 5) & (F.col("s") > 0), F.col("m") / F.col("s") * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"))


def figures_by_segment(book: DataFrame, segments: DataFrame, names: list[str]) -> DataFrame:
    long = book.unpivot(["date"], names, "book", "ret")
    return figures(in_segments(long, segments, F.col("date")), ["segment", "book"])


def daily_ic(panel: DataFrame, feature: str, target: str, least: int = 10) -> DataFrame:
    """Spearman correlation of feature and target across the names of each day."""
    rows = panel.where(F.col(feature).isNotNull() & F.col(target).isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy("date").orderBy(c)) + (F.count("*").over(Window.partitionBy("date", c)) - 1) / 2
    ranked = rows.select("date", rank(feature).alias("a"), rank(target).alias("b"))
    return ranked.groupBy("date").agg(F.count("*").alias("n"), (F.round(correlation("a", "b"), 9) + 0.0).alias("ic")).where(F.col("n") >= least)
