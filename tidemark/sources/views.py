"""Stand-in tables over the shared test tables, and the same views as SQL text for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade prints out of events: symbol, ts, seq, price, volume, side."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), (100 + F.col("value")).alias("price"),
        (1 + F.get_json_object("props", "$.k").cast("double")).alias("volume"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("side"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.from_ticks(ticks(spark, sf_dir), "1 hour")


def daily(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Daily rows out of lineitem: symbol, date, open, close, high, low, amount, volume, vwap.

    `by`, symbol or date: rows that share it are in one partition, to which lines go as they are: there is little more than one for a day.
    """
    li = table(spark, sf_dir, "lineitem")
    price, quantity = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    li = li.withColumns({"symbol": F.col("l_suppkey"), "date": F.to_date("l_shipdate")})
    if by:
        li = li.select("symbol", "date", "l_extendedprice", "l_quantity").repartition(by)
    return li.groupBy("symbol", "date").agg(
        F.min(price).alias("open"), F.round(F.avg(price), 6).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.round(F.sum(price * quantity), 4).alias("amount"), F.sum(quantity).alias("volume"),
    ).withColumn("vwap", F.round(F.col("amount") / F.col("volume"), 6))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select("ts", F.col("event_id").alias("seq"), ((F.col("value") - 50) / 10000).alias("funding_rate"))


def industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("industry"))


SEGMENTS = (("early", "1995-01-01", "1997-06-30", "bear"), ("middle", "1997-07-01", "1999-12-31", "bull"), ("late", "2000-01-01", "2001-12-31", "chop"))


def segments(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{i}', date '{a}', date '{b}', '{r}')" for i, a, b, r in SEGMENTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(segment, start_date, end_date, regime)")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades out of orders: symbol, side, entry_time, exit_time, pnl_r."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("double")
    stats = o.agg(F.avg(price).alias("m"), F.stddev_samp(price).alias("s"))
    return o.crossJoin(F.broadcast(stats)).select(  # one row of statistics
        F.col("o_orderkey").alias("trade_id"), F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("side"),
        F.to_date("o_orderdate").alias("entry_time"), F.date_add(F.to_date("o_orderdate"), 5).alias("exit_time"), F.round((price - F.col("m")) / F.col("s"), 6).alias("pnl_r"),
    )


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
        F.col("l_quantity").cast("double").alias("feature"), (F.col("l_discount").cast("double") >= 0.05).alias("is_good"), F.col("l_tax").cast("double").alias("r"),
    )


TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, 100 + value AS price, 1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side FROM events)"


def bars_sql(name: str, interval: str, source: str = "ticks") -> str:
    return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL '{interval}', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close,
  sum(volume) AS volume, count(*) AS trade_count, sum(CASE WHEN side = 1 THEN volume ELSE 0 END) AS buy_qty, sum(CASE WHEN side = -1 THEN volume ELSE 0 END) AS sell_qty,
  CASE WHEN sum(volume) FILTER (side IN (1, -1)) > 0 THEN sum(CASE WHEN side = 1 THEN volume ELSE 0 END) / sum(volume) FILTER (side IN (1, -1)) ELSE 0.5 END AS taker_buy_ratio FROM {source} GROUP BY 1, 2)"""


HOURLY = f"{TICKS}, {bars_sql('bars', '1 hour')}"
DAILY = """daily0 AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, min(CAST(l_extendedprice AS DOUBLE)) AS open, round(avg(CAST(l_extendedprice AS DOUBLE)), 6) AS close, max(CAST(l_extendedprice AS DOUBLE)) AS high,
  min(CAST(l_extendedprice AS DOUBLE)) AS low, round(sum(CAST(l_extendedprice AS DOUBLE) * CAST(l_quantity AS DOUBLE)), 4) AS amount, sum(CAST(l_quantity AS DOUBLE)) AS volume FROM lineitem GROUP BY 1, 2),
daily AS (SELECT *, round(amount / volume, 6) AS vwap FROM daily0)"""
FUNDING = "funding AS (SELECT ts, event_id AS seq, (value - 50) / 10000 AS funding_rate FROM events WHERE event_type = 'error')"
INDUSTRY = "industry AS (SELECT s_suppkey AS symbol, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
SEGMENT_ROWS = "segments(segment, start_date, end_date, regime) AS (VALUES " + ", ".join(f"('{i}', DATE '{a}', DATE '{b}', '{r}')" for i, a, b, r in SEGMENTS) + ")"
TRADES = """trades AS (SELECT o_orderkey AS trade_id, o_orderpriority AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, CAST(o_orderdate AS DATE) AS entry_time, CAST(o_orderdate AS DATE) + 5 AS exit_time,
  round((CAST(o_totalprice AS DOUBLE) - (SELECT avg(CAST(o_totalprice AS DOUBLE)) FROM orders)) / (SELECT stddev_samp(CAST(o_totalprice AS DOUBLE)) FROM orders), 6) AS pnl_r FROM orders)"""
SCAN = "scan AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey AS k1, l_linenumber AS k2, CAST(l_quantity AS DOUBLE) AS feature, CAST(l_discount AS DOUBLE) >= 0.05 AS is_good, CAST(l_tax AS DOUBLE) AS r FROM lineitem)"
