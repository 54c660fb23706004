"""Streaming forms of bars, flow, funnels, sessions and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(ticks: DataFrame, interval: str, late: str = "2 minutes") -> DataFrame:
    """Bars that are closed: each leaves once the watermark has passed its end."""
    first = F.struct("ts", "seq")
    buy = F.sum(F.when(F.col("side") == 1, F.col("volume")).otherwise(0))
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", interval).alias("w")).agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", first).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trade_count"), buy.alias("buy_qty"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count", "buy_qty")


def flow(ticks: DataFrame, length: str, step: str, late: str = "2 minutes") -> DataFrame:
    """Buy against sell volume in sliding windows."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("volume")).otherwise(0))
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length, step).alias("w"))
    return g.agg(((side(1) - side(-1)) / F.sum("volume")).alias("imbalance"), F.count("*").alias("n")).select("symbol", F.col("w.start").alias("ts"), "imbalance", "n")


def funnel(ticks: DataFrame, interval: str = "15 minutes", late: str = "2 minutes") -> DataFrame:
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", interval).alias("w"), F.col("symbol").alias("stage")).count().select(F.col("w.start").alias("ts"), "stage", "count")


def sessions(ticks: DataFrame, gap: str, late: str = "2 minutes") -> DataFrame:
    """Bursts of prints with less than `gap` between neighbours."""
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum("volume").alias("volume")).select("symbol", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "volume")


def once_per_bucket(ticks: DataFrame, interval: str, late: str) -> DataFrame:
    """At most one decision for a symbol and bucket, whichever comes first."""
    bucket = ticks.withColumn("bucket", F.window("ts", interval)["start"])
    return bucket.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "bucket"]).select("symbol", "bucket")


def runs(ticks: DataFrame) -> DataFrame:
    """Runs of prints on one side: a row for each finished run, the open run is kept as state between batches."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, n, volume, started = state.get if state.exists else (0, 0, 0.0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for s, v, t in zip(rows["side"], rows["volume"], rows["ts"]):
            if s != side and n:
                out.append((key[0], started, side, n, volume))
                n, volume = 0, 0.0
            if not n:
                started = t.to_pydatetime()
            side, n, volume = int(s), n + 1, volume + float(v)
        state.update((side, n, volume, started))
        yield pd.DataFrame(out, columns=["symbol", "started", "side", "n", "volume"])

    return ticks.select("symbol", "ts", "seq", "side", "volume").groupBy("symbol").applyInPandasWithState(
        follow, "symbol string, started timestamp, side int, n int, volume double", "side int, n int, volume double, started timestamp", "append", GroupStateTimeout.NoTimeout)


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one trigger in order; the trigger's size bounds them."""
    return pd.concat(list(batches)).sort_values(by)


def buckets(ticks: DataFrame, size: float) -> DataFrame:
    """Equal-volume buckets per symbol: a row for each that is full; the open one is kept as state between triggers."""

    def fill(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket, buy, sell = state.get if state.exists else (0, 0.0, 0.0)
        out = []
        for side, volume, t in _ordered(batches, ["ts", "seq"])[["side", "volume", "ts"]].itertuples(index=False, name=None):
            while volume > 0:
                part = min(volume, size - buy - sell)
                volume -= part
                buy, sell = (buy + part, sell) if side == 1 else (buy, sell + part)
                if buy + sell >= size * (1 - 1e-9):
                    out.append((key[0], bucket, buy, sell, t, abs(buy - sell) / size))
                    bucket, buy, sell = bucket + 1, 0.0, 0.0
        state.update((bucket, buy, sell))
        yield pd.DataFrame(out, columns=["symbol", "bucket", "buy", "sell", "ended", "imbalance"]).astype({"bucket": "int64", "buy": float, "sell": float, "imbalance": float, "ended": "datetime64[ns]"})

    return ticks.select("symbol", "ts", "seq", "side", "volume").groupBy("symbol").applyInPandasWithState(
        fill, "symbol string, bucket long, buy double, sell double, ended timestamp, imbalance double", "bucket long, buy double, sell double", "append", GroupStateTimeout.NoTimeout)


def smoothed(ticks: DataFrame, n: int) -> DataFrame:
    """The exponential mean of the price after each print, from the first price on, kept as state between triggers."""
    a = 2.0 / (n + 1)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows, out = _ordered(batches, ["ts", "seq"]), []
        for price in rows["price"]:
            now = price if now is None else now + a * (price - now)
            out.append(now)
        state.update((float(now),))
        yield rows[["symbol", "seq"]].assign(ema=out)

    return ticks.select("symbol", "ts", "seq", "price").groupBy("symbol").applyInPandasWithState(follow, "symbol string, seq long, ema double", "ema double", "append", GroupStateTimeout.NoTimeout)


def merged_into(layer: str):
    """For foreachBatch: closed bars of a trigger are merged into the layer's months that they touch; other months stay."""
    from tidemark.sources import store

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        months = [r.month for r in batch.select(F.date_format("ts", "yyyy-MM").alias("month")).distinct().collect()]  # of one trigger
        if not months:
            return
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(layer)
        there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
        if there:
            old = spark.read.parquet(layer).where(F.col("month").isin(months)).drop("month")
            staged = f"{layer}-staged"
            store.merged(old, batch).write.mode("overwrite").parquet(staged)  # the layer cannot be read and replaced at once
            batch = spark.read.parquet(staged)
        store.write_layer(batch, layer)

    return write
