"""Joins: as-of, interval, point in time, dimensions, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Frames
from tidemark.operators import joins
from tidemark.operators.bars import BY_TIME
from tidemark.plans.register import query
from tidemark.sources import views
from tidemark.sources.views import DAILY, FUNDING, HOURLY, INDUSTRY, SEGMENT_ROWS, TICKS, TRADES


@query("jn01_funding_asof", f"""WITH {HOURLY}, {FUNDING}, z AS (SELECT ts, seq, funding_rate, CASE WHEN count(*) OVER w >= 10 AND stddev_samp(funding_rate) OVER w > 0 THEN (funding_rate - avg(funding_rate) OVER w) / stddev_samp(funding_rate) OVER w END AS funding_z
FROM funding WINDOW w AS (ORDER BY ts, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT b.symbol, b.ts, b.close, z.funding_rate, z.funding_z FROM bars b ASOF LEFT JOIN z ON b.ts >= z.ts""")
def _(spark, d):
    native = joins.in_blocks(views.funding(spark, d), "ts", "seq", warm=49)
    native = native.withColumn("funding_z", Frames(("_block",), ("_n",)).zscore("funding_rate", 50, 10)).where("_own")
    left = views.hourly(spark, d).select("symbol", "ts", "close")
    return joins.asof_one_series(left, native.select("ts", "seq", "funding_rate", "funding_z"), "ts", "ts", ["funding_rate", "funding_z"], "seq")


@query("jn02_jn16_symbol_asof", f"""WITH {HOURLY}, t AS (SELECT symbol, ts + INTERVAL 7 MINUTE AS ts, close FROM bars) SELECT t.symbol, t.ts, t.close, b.ts AS bar_ts, CASE WHEN b.ts + INTERVAL 30 MINUTE >= t.ts THEN b.open END AS mark
FROM t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.ts >= b.ts""")
def _(spark, d):
    b = views.hourly(spark, d)
    left = b.select("symbol", (F.col("ts") + F.expr("INTERVAL 7 MINUTES")).alias("ts"), "close")
    right = b.select("symbol", F.col("ts").alias("bar_ts"), F.col("open").alias("mark"))
    return joins.asof(left, right, ["symbol"], "ts", "bar_ts", ["bar_ts", "mark"], tolerance="30 MINUTES").select("symbol", "ts", "close", "bar_ts", "mark")


@query("jn05_event_window", f"""WITH {HOURLY}, ev AS (SELECT CAST(ts AS DATE) AS day, max(value) AS usd FROM events WHERE event_type = 'purchase' AND value > 95 GROUP BY 1), k AS (SELECT CAST(unnest(generate_series(day + 1, day + 3, INTERVAL 1 DAY)) AS DATE) AS d, day, usd FROM ev),
l AS (SELECT d, max(day) AS event, arg_max(usd, day) AS usd FROM k GROUP BY d) SELECT symbol, ts, CASE WHEN event IS NOT NULL THEN 1 ELSE 0 END AS in_window, CAST(date_diff('day', event, CAST(ts AS DATE)) AS INTEGER) AS days_since, ln(1 + usd) AS log_size FROM bars LEFT JOIN l ON CAST(ts AS DATE) = l.d""")
def _(spark, d):
    ev = views.table(spark, d, "events").where("event_type = 'purchase' AND value > 95").groupBy(F.to_date("ts").alias("day")).agg(F.max("value").alias("usd"))
    return joins.event_window(views.hourly(spark, d), ev, F.to_date("ts"), "day", 3, "usd").select("symbol", "ts", "in_window", "days_since", "log_size")


@query("jn06_jn07_anchor_return", f"""WITH {HOURLY}, r AS (SELECT ts, close / lag(close) OVER (ORDER BY ts) - 1 AS ret FROM bars WHERE symbol = 'click'), a AS (SELECT ts, lag(ret) OVER (ORDER BY ts) AS anchor_return FROM r)
SELECT b.symbol, b.ts, b.close, a.anchor_return FROM bars b LEFT JOIN a USING (ts)""")
def _(spark, d):
    return joins.anchor_return(views.hourly(spark, d), "click").select("symbol", "ts", "close", "anchor_return")


@query("jn13_funding_paid", f"""WITH {FUNDING}, t AS (SELECT symbol, ts AS entry, ts + INTERVAL 6 HOUR AS exit_at FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts FROM events GROUP BY ALL))
SELECT t.symbol, t.entry, t.exit_at, coalesce(sum(f.funding_rate), 0) AS paid FROM t LEFT JOIN funding f ON f.ts > t.entry AND f.ts <= t.exit_at GROUP BY ALL""")
def _(spark, d):
    t = views.hourly(spark, d).select("symbol", F.col("ts").alias("entry"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("exit_at"))
    return joins.interval_sum(t, views.funding(spark, d), "entry", "exit_at", "ts", "funding_rate", "paid")


@query("jn14_bar_max_notional", f"""WITH {HOURLY}, m AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, max(price * volume) AS max_notional FROM ticks GROUP BY 1, 2)
SELECT b.symbol, b.ts, m.max_notional, CASE WHEN count(m.max_notional) OVER w >= 20 THEN quantile_cont(m.max_notional, 0.99) OVER w END AS p99 FROM bars b JOIN m USING (symbol, ts) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    t = views.ticks(spark, d)
    m = t.groupBy("symbol", F.window("ts", "1 hour")["start"].alias("ts")).agg(F.max(F.col("price") * F.col("volume")).alias("max_notional"))
    rows = views.hourly(spark, d).select("symbol", "ts").join(m, ["symbol", "ts"])
    return rows.withColumn("p99", BY_TIME.quantile("max_notional", 100, 0.99, 20))


@query("jn18_io15_sector_and_segment", f"""WITH {DAILY}, {INDUSTRY}, {SEGMENT_ROWS} SELECT i.industry, s.segment, s.regime, count(*) AS n, sum(d.amount) AS amount FROM daily d JOIN industry i USING (symbol) JOIN segments s ON d.date BETWEEN s.start_date AND s.end_date GROUP BY ALL""")
def _(spark, d):
    rows = views.daily(spark, d).join(views.industry(spark, d), "symbol")
    return joins.in_segments(rows, views.segments(spark), F.col("date")).groupBy("industry", "segment", "regime").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("jn17_membership", f"""WITH {DAILY}, snap AS (SELECT DISTINCT symbol FROM daily WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-01-20') SELECT d.symbol, d.date, d.close, d.symbol IN (SELECT symbol FROM snap) AS member FROM daily d""")
def _(spark, d):
    daily = views.daily(spark, d)
    snap = daily.where("date BETWEEN date '1997-01-01' AND date '1997-01-20'").select("symbol")
    inside, outside = (joins.membership(daily, snap, ["symbol"], p).select("symbol", "date", "close", F.lit(p).alias("member")) for p in (True, False))
    return inside.unionByName(outside)


@query("jn19_trading_day_after", f"""WITH {DAILY}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM daily)), t AS (SELECT trade_id, entry_time FROM tr), {TRADES.replace('trades AS', 'tr AS')}
SELECT t.trade_id, t.entry_time, c.date AS snapped, e.date AS end_date FROM t ASOF LEFT JOIN c ON t.entry_time >= c.date LEFT JOIN c e ON e.k = c.k + 20""".replace("t AS (SELECT trade_id, entry_time FROM tr), tr AS", "tr AS").replace("FROM orders)\nSELECT", "FROM orders), t AS (SELECT trade_id, entry_time FROM tr)\nSELECT"))
def _(spark, d):
    days = views.daily(spark, d).select("date").distinct()
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # one row a trading day
    c = days.select(F.col("date").alias("snapped"), F.row_number().over(w).alias("k"))
    t = views.trades(spark, d).select("trade_id", "entry_time")
    dates = t.select("entry_time").distinct().withColumn("one", F.lit(1))  # one row a date
    at = joins.asof(dates, c.withColumn("one", F.lit(1)), ["one"], "entry_time", "snapped", ["snapped", "k"])
    ends = c.select(F.col("snapped").alias("end_date"), (F.col("k") - 20).alias("k"))
    return t.join(at.join(ends, "k", "left").select("entry_time", "snapped", "end_date"), "entry_time").select("trade_id", "entry_time", "snapped", "end_date")


@query("jn12_se02_full_merge", f"""WITH {HOURLY}, a AS (SELECT symbol, ts, close, volume FROM bars WHERE hour(ts) < 14), b AS (SELECT symbol, ts, open AS close, trade_count FROM bars WHERE hour(ts) >= 10)
SELECT symbol, ts, coalesce(a.close, b.close) AS close, a.volume, b.trade_count FROM a FULL JOIN b USING (symbol, ts)""")
def _(spark, d):
    h = views.hourly(spark, d)
    a = h.where("hour(ts) < 14").select("symbol", "ts", "close", "volume")
    b = h.where("hour(ts) >= 10").select("symbol", "ts", F.col("open").alias("close"), "trade_count")
    return joins.merged(a, b, ["symbol", "ts"])


@query("se01_union_keep_last", f"""WITH {TICKS}, u AS (SELECT symbol, ts, seq, price, 1 AS v FROM ticks WHERE seq % 2 = 0 UNION ALL SELECT symbol, ts, seq, price + 1, 2 FROM ticks WHERE seq % 3 = 0)
SELECT symbol, ts, seq, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts, seq ORDER BY v DESC) AS k FROM u) WHERE k = 1""")
def _(spark, d):
    t = views.ticks(spark, d).select("symbol", "ts", "seq", "price")
    u = t.where("seq % 2 = 0").withColumn("v", F.lit(1)).unionByName(t.where("seq % 3 = 0").withColumns({"price": F.col("price") + 1, "v": F.lit(2)}))
    return u.groupBy("symbol", "ts", "seq").agg(F.max_by("price", "v").alias("price"))


@query("se03_se04_se05_se06_sets", f"""WITH {DAILY}, a AS (SELECT symbol, date FROM daily WHERE symbol % 2 = 0), b AS (SELECT symbol, date FROM daily WHERE symbol % 3 = 0)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'symbols', count(DISTINCT symbol) FROM daily""")
def _(spark, d):
    daily = views.daily(spark, d).select("symbol", "date")
    a, b = daily.where("symbol % 2 = 0"), daily.where("symbol % 3 = 0")
    count = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count(a.intersectAll(b), "both").union(count(a.exceptAll(b), "only_a")).union(count(daily.select("symbol").distinct(), "symbols"))
