"""Statistics of features against outcomes: correlations, thresholds, drift, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import correlation


def mean_rank(c: str, *keys: str) -> Column:
    """Rank with ties averaged among the rows of the keys, in one task a key: for keys of bounded size, such as a day's names."""
    w = Window.partitionBy(*keys).orderBy(c)
    return F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def ranks_of_values(rows: DataFrame, value: str, *keys: str, parts: int = 64) -> DataFrame:
    """keys, value, place (its rank with ties averaged) and rank (place over the number of rows), for keys of any size.

    Equal values are counted first. A key's values are cut into parts at approximate
    quantiles; each part is sorted by itself and begins where the counts of the parts before it
    end, so no task sees more than about a share of 1 / parts of a key's distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    edges = counts.groupBy(*keys).agg(F.percentile_approx(value, F.array(*(F.lit(k / parts) for k in range(1, parts))), 10_000).alias("edges"), F.sum("n").alias("total"))
    placed = counts.join(edges, list(keys)) if keys else counts.crossJoin(F.broadcast(edges))  # one row
    placed = placed.withColumn("part", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")
    sums = placed.groupBy(*keys, "part").agg(F.sum("n").alias("of_part"))  # at most `parts` rows a key
    before = F.sum("of_part").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "part", F.coalesce(before, F.lit(0)).alias("before"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(value))
    place = F.col("before") + F.col("upto") - (F.col("n") - 1) / 2
    return placed.withColumn("upto", upto).join(sums, [*keys, "part"]).select(*keys, value, place.alias("place"), (place / F.col("total")).alias("rank"))


def rank_ic(rows: DataFrame, features: list[str], targets: list[str], least: int = 100) -> DataFrame:
    """Spearman correlation of each feature with each target, the count, and its t statistic."""
    long = rows.unpivot(targets, features, "feature", "x").unpivot(["feature", "x"], targets, "target", "y").where("x IS NOT NULL AND y IS NOT NULL")
    pair = ["feature", "target"]
    of_x, of_y = (ranks_of_values(long, c, *pair).select(*pair, c, F.col("place").alias(name)) for c, name in (("x", "a"), ("y", "b")))
    ranked = long.join(of_x, [*pair, "x"]).join(of_y, [*pair, "y"])
    out = ranked.groupBy("feature", "target").agg(F.count("*").alias("n"), correlation("a", "b").alias("ic")).where(F.col("n") >= least)
    return out.withColumn("t", F.col("ic") * F.sqrt((F.col("n") - 2) / (1 - F.col("ic") ** 2)))


def threshold_scan(rows: DataFrame, feature: str, good: str, r: str, steps: int) -> DataFrame:
    """For `steps` thresholds between the smallest and largest value: pass rates of good and bad rows, lift of a rule that keeps values at or above, and mean R kept.

    One pass: rows are counted by the step they fall in and the counts summed from above.
    """
    rows = rows.where(F.col(feature).isNotNull())
    span = F.broadcast(rows.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi")))  # one row
    at = F.least(F.floor((F.col(feature) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / steps)), F.lit(steps - 1)).cast("int")
    counts = rows.crossJoin(span).groupBy(F.coalesce(at, F.lit(0)).alias("step")).agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count(F.when(F.col(good), 1)).alias("good"), F.count(F.when(~F.col(good), 1)).alias("bad"), F.sum(r).alias("r"))
    above = Window.partitionBy(F.lit(1)).orderBy(F.desc("step"))  # `steps` rows
    all_rows = Window.partitionBy(F.lit(1))
    out = counts.select(
        "step", (F.col("lo") + F.col("step") * (F.col("hi") - F.col("lo")) / steps).alias("threshold"), (F.sum("good").over(above) / F.sum("good").over(all_rows)).alias("pass_good"),
        (F.sum("bad").over(above) / F.sum("bad").over(all_rows)).alias("pass_bad"), (F.sum("good").over(above) + F.sum("bad").over(above)).alias("kept"), F.sum("r").over(above).alias("r"))
    return out.select("step", "threshold", "pass_good", "pass_bad", F.when(F.col("pass_bad") >= 0.01, F.col("pass_good") / F.col("pass_bad") - 1).alias("lift"), "kept", (F.col("r") / F.col("kept")).alias("mean_r"))


def plateau(scan: DataFrame, by: list[str], score: str, spread: float = 0.2) -> DataFrame:
    """The longest run of neighbouring steps whose score stays within a share `spread` of its own start: from, to, length, mean score.

    The greedy rule is sequential over a few hundred grid rows a group.
    """
    names = [*by, "first_step", "last_step", "steps", "score"]

    def longest(pdf):
        import pandas as pd

        pdf = pdf.sort_values("step")
        best, start = None, 0
        values, steps = pdf[score].to_numpy(), pdf["step"].to_numpy()
        for i in range(len(values)):
            if values[i] != values[i]:
                start = i + 1
                continue
            while start < i and abs(values[i] - values[start]) > spread * abs(values[start]):
                start += 1
            if best is None or i - start + 1 > best[1] - best[0]:
                best = (start, i + 1)
        if best is None:
            return pd.DataFrame(columns=names)
        a, b = best
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), steps[a], steps[b - 1], b - a, values[a:b].mean()]], columns=names)

    shape = ", ".join([*(f"{k} {scan.schema[k].dataType.simpleString()}" for k in by), "first_step int, last_step int, steps int, score double"])
    return scan.groupBy(*by).applyInPandas(longest, shape)


def stability_index(reference: DataFrame, current: DataFrame, column: str, bins: int = 10, least: tuple[int, int] = (100, 50)) -> DataFrame:
    """Population stability index of current rows on the reference's quantile bins, and both counts."""
    grid = [i / bins for i in range(1, bins)]
    edges = F.broadcast(reference.agg(F.array_sort(F.array_distinct(F.percentile(column, F.array(*map(F.lit, grid))))).alias("edges")))  # one row
    at = F.size(F.filter("edges", lambda e: F.col(column) > e))
    count = lambda df, name: df.where(F.col(column).isNotNull()).crossJoin(edges).groupBy(at.alias("bin")).agg(F.count("*").alias(name))
    both = count(reference, "a").join(count(current, "b"), "bin", "full_outer").na.fill(0, ["a", "b"])
    w = Window.partitionBy(F.lit(1))  # one row a bin
    pa, pb = (F.greatest(F.col(c) / F.sum(c).over(w), F.lit(1e-6)) for c in "ab")
    parts = both.select("a", "b", ((pb - pa) * F.log(pb / pa)).alias("part"))
    out = parts.agg(F.sum("a").alias("n_reference"), F.sum("b").alias("n_current"), F.sum("part").alias("psi"))
    return out.withColumn("psi", F.when((F.col("n_reference") >= least[0]) & (F.col("n_current") >= least[1]), F.col("psi")))


def out_of_range(rows: DataFrame, baseline: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """Share of a row's non-null features outside the baseline's [q05, q95]; null without any."""
    bounds = F.broadcast(baseline.agg(*(F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))).alias("_" + c) for c in features)))  # one row
    outside = sum(F.when((F.col(c) < F.col("_" + c)[0]) | (F.col(c) > F.col("_" + c)[1]), 1).otherwise(0) for c in features)
    present = sum(F.col(c).isNotNull().cast("int") for c in features)
    return rows.crossJoin(bounds).select(*key, F.when(present > 0, outside / present).alias("ood"))


def strata(rows: DataFrame, by: list[str], feature: str, threshold: float, good: str, r: str) -> DataFrame:
    """Bad rate and median R of rows at or above a threshold and of the rest, and the z of the two rates."""
    signal = F.col(feature) >= threshold
    out = rows.where(F.col(feature).isNotNull()).groupBy(*by).agg(
        F.count(F.when(signal, 1)).alias("n_signal"), F.count(F.when(~signal, 1)).alias("n_rest"), F.avg(F.when(signal, (~F.col(good)).cast("int"))).alias("bad_signal"),
        F.avg(F.when(~signal, (~F.col(good)).cast("int"))).alias("bad_rest"), F.percentile(F.when(signal, F.col(r)), F.lit(0.5)).alias("median_signal"), F.percentile(F.when(~signal, F.col(r)), F.lit(0.5)).alias("median_rest"))
    n, m = F.col("n_signal"), F.col("n_rest")
    p = (F.col("bad_signal") * n + F.col("bad_rest") * m) / (n + m)
    sd = F.sqrt(p * (1 - p) * (1 / n + 1 / m))
    return out.withColumn("z", F.when((n > 0) & (m > 0) & (sd > 0), (F.col("bad_signal") - F.col("bad_rest")) / sd))


def area_under_curve(rows: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """The chance that a positive row scores above a negative one, ties counted half."""
    ranked = rows.where(F.col(score).isNotNull()).withColumn("_rank", mean_rank(score, *by))
    g = ranked.groupBy(*by).agg(F.sum(F.when(F.col(positive), F.col("_rank"))).alias("s"), F.count(F.when(F.col(positive), 1)).alias("n1"), F.count(F.when(~F.col(positive), 1)).alias("n0"))
    return g.select(*by, "n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def trade_results(trades: DataFrame, by: list[str], r: str = "pnl_r", order: tuple[str, ...] = ("exit_time", "trade_id")) -> DataFrame:
    """Trades, win rate, mean and total R, Sharpe of R, and the largest drawdown of the running sum."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = trades.withColumn("_run", F.sum(r).over(w)).withColumn("_dd", F.greatest(F.lit(0.0), F.max("_run").over(w)) - F.col("_run"))
    out = run.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(r) > 0).cast("int")).alias("win_rate"), F.avg(r).alias("mean_r"), F.sum(r).alias("total_r"), F.stddev_samp(r).alias("s"), F.max("_dd").alias("max_drawdown_r"))
    return out.select(*by, "n", "win_rate", "mean_r", "total_r", F.when(F.col("s") > 0, F.col("mean_r") / F.col("s")).alias("sharpe_r"), "max_drawdown_r")


def gate_effect(rows: DataFrame, by: list[str], vetoed: Column, r: str, tail: float = 0.1) -> DataFrame:
    """How often a gate vetoes, and what the vetoed rows earn against the allowed ones, on average and in the tail."""
    rows = rows.withColumn("_veto", vetoed)
    v = F.col("_veto")
    cut = rows.groupBy(*by).agg(F.percentile(F.when(v, F.col(r)), F.lit(tail)).alias("_qv"), F.percentile(F.when(~v, F.col(r)), F.lit(tail)).alias("_qa"))
    return rows.join(cut, by).groupBy(*by).agg(
        F.avg(v.cast("int")).alias("activation"), (F.avg(F.when(v, F.col(r))) - F.avg(F.when(~v, F.col(r)))).alias("mean_gap"), F.avg(F.when(v, (F.col(r) > 0).cast("int"))).alias("vetoed_winners"),
        (F.avg(F.when(v & (F.col(r) <= F.col("_qv")), F.col(r))) - F.avg(F.when(~v & (F.col(r) <= F.col("_qa")), F.col(r)))).alias("tail_gap"))


def asset_figures(returns: DataFrame, by: list[str], r: str, order: tuple[str, ...]) -> DataFrame:
    """Mean, deviation, mean of the worst 5 %, and the largest drawdown of compounded returns."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.where(F.col(r).isNotNull()).withColumn("_q", F.percentile(r, F.lit(0.05)).over(Window.partitionBy(*by))).withColumn("_eq", F.exp(F.sum(F.log1p(r)).over(w)))
    rows = rows.withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    return rows.groupBy(*by).agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.avg(F.when(F.col(r) <= F.col("_q"), F.col(r))).alias("cvar_5"), F.min("_dd").alias("max_drawdown"))


def purged(train: DataFrame, validation: DataFrame, start: str, end: str) -> DataFrame:
    """Training rows whose label span [start, end] meets no validation span; the validation range is one row."""
    span = F.broadcast(validation.agg(F.min(start).alias("_a"), F.max(end).alias("_b")))
    return train.crossJoin(span).where((F.col(end) < F.col("_a")) | (F.col(start) > F.col("_b"))).drop("_a", "_b")


def expanding_months(rows: DataFrame, ts: str) -> DataFrame:
    """Each month with data and the earlier months to train on: how many, and the first and last of them."""
    months = rows.select(F.trunc(ts, "month").alias("month")).distinct()
    w = Window.partitionBy(F.lit(1)).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)  # one row a month
    return months.select("month", F.count("*").over(w).alias("train_months"), F.min("month").over(w).alias("train_from"), F.max("month").over(w).alias("train_to"))


def robustness(rows: DataFrame, feature: str, good: str, threshold: float, step: float, key: str, order: list[str], least: int = 50) -> DataFrame:
    """How much a rule that keeps values at or above a threshold depends on it, and on time: one row.

    parameter_stability: 1 / (1 + 10 x), x the mean change of the pass rates (of all, and half
    those of good and bad) when the threshold moves by a step either way, over the pass rate.
    temporal_stability: 1 / (1 + 5 x) of the two halves of each key's rows, weighted by the rows
    of keys that have `least`.
    """
    passes = lambda t: (F.col(feature) >= t).cast("int")
    rates = lambda t: (F.avg(passes(t)), F.coalesce(F.avg(F.when(F.col(good), passes(t))), F.lit(0.0)), F.coalesce(F.avg(F.when(~F.col(good), passes(t))), F.lit(0.0)))
    names = [f"{k}{x}" for k in "abc" for x in ("p", "g", "b")]
    e = rows.agg(*(c.alias(n) for n, c in zip(names, (r for t in (threshold, threshold - step, threshold + step) for r in rates(t)))))
    moved = lambda k, of: F.abs(F.col(k + "p") - F.col(of + "p")) + 0.5 * (F.abs(F.col(k + "g") - F.col(of + "g")) + F.abs(F.col(k + "b") - F.col(of + "b")))
    change = (moved("b", "a") + moved("c", "a")) / 2 / F.greatest("ap", F.lit(0.1))
    parameter = e.select((1 / (1 + 10 * change) * F.when(F.col("ab") < 0.05, 0.7).otherwise(1.0)).alias("parameter_stability"))
    n = F.count("*").over(Window.partitionBy(key))
    halves = rows.withColumns({"_n": n, "_k": F.row_number().over(Window.partitionBy(key).orderBy(*order))}).where(F.col("_n") >= least)
    m = halves.groupBy(key, F.expr("_k > _n DIV 2").alias("late")).agg(F.first("_n").alias("n"), *(c.alias(x) for x, c in zip("pgb", rates(threshold))))
    sides = m.groupBy(key).agg(F.first("n").alias("n"), *(F.sum(F.when(F.col("late"), F.col(x)).otherwise(-F.col(x))).alias(x) for x in "pgb"))
    score = 1 / (1 + 5 * (F.abs("p") + 0.5 * (F.abs("g") + F.abs("b"))))
    temporal = sides.agg((F.sum(F.col("n") * score) / F.sum("n")).alias("temporal_stability"))
    return parameter.crossJoin(F.broadcast(temporal))  # one row each
