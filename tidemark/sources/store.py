"""Feature layers as parquet partitioned by symbol and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Frames

KEYS = ["symbol", "ts"]
PARTS = ["symbol", "month"]


def _with_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.date_format("ts", "yyyy-MM"))


def write_layer(rows: DataFrame, path: str) -> None:
    """Replaces the symbol-months that rows touch, no others."""
    _with_month(rows).write.partitionBy(*PARTS).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_range(spark: SparkSession, path: str, start: str, end: str, columns: list[str] | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Rows of the closed interval [start, end]; months and symbols prune partitions, columns the scan."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("month").between(start[:7], end[:7]) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if symbols:
        rows = rows.where(F.col("symbol").isin(symbols))
    return rows.select(*KEYS, *(columns or [c for c in rows.columns if c not in (*KEYS, "month")]))


def load_bars(rows: DataFrame, keys: list[str], day: str, start: str, end: str, version: str) -> DataFrame:
    """Rows of the closed interval of days; of rows with one key the latest version."""
    some = rows.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    rest = [c for c in rows.columns if c not in (*keys, version)]
    return some.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_row")).select(*keys, "_row.*")


def delete_month(spark: SparkSession, path: str, symbol: str, month: str) -> bool:
    """Drops the folder of one symbol and month; whether it was there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/symbol={symbol}/month={month}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def months_present(spark: SparkSession, path: str) -> DataFrame:
    """symbol, month and their rows, read from the partitions' footers alone."""
    return spark.read.parquet(path).groupBy(*PARTS).agg(F.count("*").alias("n"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of rows and columns; a row that new has takes all of new's columns, nulls included."""
    n = new.select(*KEYS, F.lit(True).alias("_new"), *(F.col(c).alias("_n_" + c) for c in new.columns if c not in KEYS))
    both = old.join(n, KEYS, "full_outer")
    names = [c for c in old.columns if c not in KEYS] + [c for c in new.columns if c not in KEYS and c not in old.columns]
    pick = lambda c: F.when(F.col("_new"), F.col("_n_" + c)).otherwise(F.col(c) if c in old.columns else None) if c in new.columns else F.col(c)
    return both.select(*KEYS, *(pick(c).alias(c) for c in names))


def health(layer: DataFrame) -> DataFrame:
    """Per symbol and month the rows and how many columns hold any value."""
    columns = [c for c in layer.columns if c not in (*KEYS, "month")]
    g = _with_month(layer).groupBy(*PARTS).agg(F.count("*").alias("n"), *(F.count(c).alias("_" + c) for c in columns))
    return g.select(*PARTS, "n", sum((F.col("_" + c) > 0).cast("int") for c in columns).alias("columns_present"))


def last_features(layer: DataFrame, warm: int, features: dict) -> DataFrame:
    """The newest row of each symbol with features that look back over at most `warm` rows: name to a function of frames."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    tail = layer.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= warm)
    f = Frames(("symbol",), ("ts",))
    return tail.withColumns({n: make(f) for n, make in features.items()}).where("_back = 1").drop("_back")
