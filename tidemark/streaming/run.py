"""Structured Streaming over a folder of event files, run to the end of what is there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; in local mode, where that is unset, below one temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidemark-stream-"))
    return f"{named.rstrip('/')}/tidemark/{uuid.uuid4().hex}/{name}"


def ticks(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream of trade prints; a trigger takes one file, which bounds what a key gets at once."""
    shape = spark.read.parquet(f"{folder}/{name}").schema
    e = spark.readStream.schema(shape).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder)
    return e.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("user_id"), (100 + F.col("value")).alias("price"),
        (1 + F.get_json_object("props", "$.k").cast("double")).alias("volume"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("side"),
    )


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream until no input is left and gives what it wrote."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, name + "-state")
    run = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return spark.read.schema(stream.schema).parquet(out)


def each_batch(stream: DataFrame, name: str, write) -> None:
    """Runs write(batch, number) for each trigger until no input is left; a repeated trigger must leave the same."""
    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch(stream.sparkSession, name)).trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
