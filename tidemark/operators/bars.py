"""Time bars and what is computed on them directly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import recursive
from tidemark.functions.frames import Frames

BY_TIME = Frames(("symbol",), ("ts",))


def from_ticks(ticks: DataFrame, interval: str) -> DataFrame:
    """Bars labelled by their start; ties in time are ordered by seq. Intervals without prints give no bar."""
    first = F.struct("ts", "seq")
    buy, sell = (F.sum(F.when(F.col("side") == s, F.col("volume")).otherwise(0)) for s in (1, -1))
    return ticks.groupBy("symbol", F.window("ts", interval).alias("w")).agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", first).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("trade_count"), buy.alias("buy_qty"), sell.alias("sell_qty"),
        F.when(buy + sell > 0, buy / (buy + sell)).otherwise(0.5).alias("taker_buy_ratio"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count", "buy_qty", "sell_qty", "taker_buy_ratio")


def from_snapshots(rows: DataFrame, interval: str, values: list[str]) -> DataFrame:
    """The last snapshot of each bar that is closed: one that ends by the latest snapshot of all."""
    end = F.broadcast(rows.agg(F.max("ts").alias("_end")))  # one row
    g = rows.groupBy("symbol", F.window("ts", interval).alias("w")).agg(*(F.max_by(v, F.struct("ts", "seq")).alias(v) for v in values), F.count("*").alias("snapshots"))
    return g.crossJoin(end).where("w.end <= _end").select("symbol", F.col("w.start").alias("ts"), *values, "snapshots")


def coarser(bars: DataFrame, interval: str) -> DataFrame:
    """Bars out of finer bars; trade_count is the number of source rows, the taker ratio their mean."""
    return bars.groupBy("symbol", F.window("ts", interval).alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        F.count("*").alias("trade_count"), F.sum("buy_qty").alias("buy_qty"), F.sum("sell_qty").alias("sell_qty"), F.avg("taker_buy_ratio").alias("taker_buy_ratio"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count", "buy_qty", "sell_qty", "taker_buy_ratio").dropna()


def with_cvd(bars: DataFrame, windows: tuple[int, ...] = (5, 20, 60, 288)) -> DataFrame:
    """Signed volume, its running sum, sums over windows, and these over total flow (0 without flow)."""
    f = BY_TIME
    delta, flow = F.col("buy_qty") - F.col("sell_qty"), F.col("buy_qty") + F.col("sell_qty")
    out = {"delta": delta, "cvd": F.sum(delta).over(f.so_far)}
    for n in windows:
        out[f"cvd_{n}"] = f.sum(delta, n, 1)
        total = f.sum(flow, n, 1)
        out[f"cvd_{n}_norm"] = F.when(total > 0, f.sum(delta, n, 1) / total).otherwise(0.0)
    return bars.withColumns(out)


def weekly(bars: DataFrame) -> DataFrame:
    """Weeks that end on Sunday (the label): open first, high, low, close last, volume sum."""
    day = F.to_date("ts")
    sunday = F.date_add(day, F.pmod(8 - F.dayofweek(day), F.lit(7)))
    return bars.groupBy("symbol", sunday.alias("week_end")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def daily_regime(bars: DataFrame, lookback: int = 90, limit: float = 0.15) -> DataFrame:
    """Last close of each day, its change over `lookback` days, and bull, bear or neutral."""
    days = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("close"))
    f = Frames(("symbol",), ("day",))
    days = days.withColumn("roc", f.change("close", lookback))
    return days.withColumn("regime", F.when(F.col("roc") >= limit, "bull").when(F.col("roc") <= -limit, "bear").when(F.col("roc").isNotNull(), "neutral"))


def dense_seconds(ticks: DataFrame) -> DataFrame:
    """One row a second between a symbol's first and last print: last carried forward, high and low default to it, flows to 0."""
    second = F.date_trunc("second", "ts")
    rows = ticks.groupBy("symbol", second.alias("second")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("n_trades"),
        F.sum(F.when(F.col("side") == 1, F.col("volume")).otherwise(0)).alias("buy_qty"), F.sum(F.when(F.col("side") == -1, F.col("volume")).otherwise(0)).alias("sell_qty"),
        (F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("vwap"),
    )
    f = Frames(("symbol",), ("second",))
    following = F.coalesce(f.lead("second") - F.expr("interval 1 second"), F.col("second"))
    grid = rows.withColumn("at", F.explode(F.sequence("second", following, F.expr("interval 1 second"))))
    real = F.col("at") == F.col("second")
    pick = lambda c, other: F.when(real, F.col(c)).otherwise(other).alias(c)
    return grid.select("symbol", F.col("at").alias("ts"), "last", pick("high", F.col("last")), pick("low", F.col("last")), pick("vwap", F.col("last")), pick("buy_qty", F.lit(0.0)), pick("sell_qty", F.lit(0.0)), pick("n_trades", F.lit(0)))


def closed_at(interval: str) -> Column:
    return F.col("ts") + F.expr(f"INTERVAL {interval}")


def with_next_open(bars: DataFrame, interval: str) -> DataFrame:
    """When a bar is known, and the open at which a decision then fills."""
    return bars.select("symbol", "ts", closed_at(interval).alias("known_at"), BY_TIME.lead("open").alias("fill_price"))


def volume_buckets(ticks: DataFrame, size: float) -> DataFrame:
    """Equal-volume buckets per symbol: prints that cross an edge are split between the buckets they touch.

    bucket, buy, sell, imbalance |buy - sell| / size of each full bucket.
    """
    f = Frames(("symbol",), ("ts", "seq"))
    run = ticks.withColumn("upto", F.sum("volume").over(f.so_far)).withColumn("start", F.col("upto") - F.col("volume"))
    last = F.ceil(F.col("upto") / size) - 1
    parts = run.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / size), last)))
    part = F.least("upto", (F.col("bucket") + 1) * size) - F.greatest("start", F.col("bucket") * size)
    grouped = parts.withColumn("part", part).groupBy("symbol", "bucket").agg(
        F.sum(F.when(F.col("side") == 1, F.col("part")).otherwise(0)).alias("buy"), F.sum(F.when(F.col("side") == -1, F.col("part")).otherwise(0)).alias("sell"), F.max("ts").alias("ended"))
    return grouped.where(F.col("buy") + F.col("sell") >= size * (1 - 1e-9)).withColumn("imbalance", F.abs(F.col("buy") - F.col("sell")) / size)


def vpin(ticks: DataFrame, size: float, n: int = 50) -> DataFrame:
    """The mean imbalance of the last n full buckets."""
    buckets = volume_buckets(ticks, size)
    return buckets.withColumn("vpin", Frames(("symbol",), ("bucket",)).mean("imbalance", n, 1))


def with_flow(bars: DataFrame, ticks: DataFrame, interval: str, size: float, n: int = 50, window: int = 100) -> DataFrame:
    """Bars with the toxicity of equal-volume buckets and the runs of sides, both as of the bar's end.

    vpin and vpin_signed_imbalance: means of |buy - sell| and buy - sell over the last n
    buckets' sizes, of the last bucket that ended in or before the bar; vpin_max, vpin_min,
    vpin_mean: over the buckets that ended in it. Prints of one time are one step of a run,
    on the side that bought or sold more. ofci: twice the bought share of the last `window`
    prints' volume less one, of the bar's last print; 0 before there are as many.
    """
    at = F.window("ts", interval)["start"].alias("ts")
    b = volume_buckets(ticks, size).withColumn("signed", (F.col("buy") - F.col("sell")) / size)
    f = Frames(("symbol",), ("bucket",))
    b = b.select("symbol", "bucket", F.col("ended").alias("ts"), f.mean("imbalance", n, 1).alias("v"), f.mean("signed", n, 1).alias("s"))
    last = lambda c: F.max_by(c, "bucket")
    b = b.groupBy("symbol", at).agg(last("v").alias("vpin"), last("s").alias("vpin_signed_imbalance"), F.max("v").alias("vpin_max"), F.min("v").alias("vpin_min"), F.avg("v").alias("vpin_mean"))
    net = F.sum(F.col("side") * F.col("volume"))
    sides = ticks.groupBy("symbol", "ts").agg(F.when(net >= 0, 1).otherwise(-1).alias("side"))
    runs = recursive.sequential(sides, ["symbol"], ["ts"], ["side"], lambda: recursive.Runs(window).step, ", ".join(f"{x} double" for x in recursive.RUNS))
    runs = runs.groupBy("symbol", at).agg(F.max_by(F.struct(*recursive.RUNS), F.col("ts")).alias("r")).select("symbol", "ts", "r.*")
    w = Frames(("symbol",), ("ts", "seq")).past(window)
    bought = F.sum(F.when(F.col("side") == 1, F.col("volume")).otherwise(0)).over(w) / F.nullif(F.sum("volume").over(w), F.lit(0.0))
    ofci = ticks.withColumn("ofci", F.coalesce(F.when(F.count("*").over(w) == window, 2 * bought - 1), F.lit(0.0)))
    ofci = ofci.groupBy("symbol", at).agg(F.max_by("ofci", F.struct("ts", "seq")).alias("ofci"))
    out = bars.join(b, ["symbol", "ts"], "left").join(runs, ["symbol", "ts"], "left").join(ofci, ["symbol", "ts"], "left")
    return out.withColumns({c: BY_TIME.filled(c) for c in ("vpin", "vpin_signed_imbalance", "ofci", *recursive.RUNS)})


def session(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 8, "asia").when(h < 14, "eu").when(h < 21, "us").otherwise("late")


def month_grid(start: str, end: str, spark) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(date '{start}', date '{end}', interval 1 month)) AS month")
