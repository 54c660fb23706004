"""Daily cross-sections: factors, books, figures by calendar segment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import panels
from tidemark.plans.register import query
from tidemark.sources import views
from tidemark.sources.views import DAILY, INDUSTRY, SEGMENT_ROWS

_FACTORS = """f AS (SELECT *, close / lag(close, 20) OVER s - 1 AS mom, CASE WHEN count(amount) OVER w >= 20 AND stddev_samp(amount) OVER w > 0 THEN (amount - avg(amount) OVER w) / stddev_samp(amount) OVER w END AS amount_z,
lead(open, 2) OVER s / lead(open, 1) OVER s - 1 AS book_ret, lead(open, 21) OVER s / lead(open, 1) OVER s - 1 AS fwd FROM daily WINDOW s AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
_Z = "CASE WHEN stddev_samp({c}) OVER (PARTITION BY {k}) > 0 THEN ({c} - avg({c}) OVER (PARTITION BY {k})) / stddev_samp({c}) OVER (PARTITION BY {k}) END"
_SCORE = f"round(0.5 * {_Z.format(c='mom', k='date')} + 0.5 * {_Z.format(c='amount_z', k='date')}, 9) + 0.0"
_SCORED = f"sc AS (SELECT *, {_SCORE} AS score FROM f)"
_BOOKS = """r AS (SELECT *, quantile_cont(score, 0.8) OVER (PARTITION BY date) AS hi, quantile_cont(score, 0.2) OVER (PARTITION BY date) AS lo, count(*) OVER (PARTITION BY date) AS names FROM sc WHERE score IS NOT NULL AND book_ret IS NOT NULL),
bk AS (SELECT date, avg(book_ret) FILTER (score >= hi) AS top, avg(book_ret) FILTER (score <= lo) AS low, CASE WHEN sum(greatest(score, 0)) > 0 THEN sum(greatest(score, 0) * book_ret) / sum(greatest(score, 0)) END AS weighted,
CASE WHEN sum(greatest(-score, 0)) > 0 THEN sum(greatest(-score, 0) * book_ret) / sum(greatest(-score, 0)) END AS inverse, avg(book_ret) AS all_names, count(*) AS n FROM r WHERE names >= 10 GROUP BY date)"""
_PANEL = f"{DAILY}, {_FACTORS}, {_SCORED}"


def scored(spark, d):
    return panels.with_score(panels.with_factors(views.daily(spark, d)))


@query("pf01_factors", f"WITH {DAILY}, {_FACTORS} SELECT symbol, date, mom, amount_z, book_ret, fwd FROM f")
def _(spark, d):
    return panels.with_factors(views.daily(spark, d)).select("symbol", "date", "mom", "amount_z", "book_ret", "fwd")


@query("pf02_score", f"WITH {_PANEL} SELECT symbol, date, score FROM sc WHERE score IS NOT NULL")
def _(spark, d):
    return scored(spark, d).where("score IS NOT NULL").select("symbol", "date", "score")


@query("pf03_daily_books", f"WITH {_PANEL}, {_BOOKS} SELECT date, top, low, weighted, inverse, all_names, n, top - all_names AS excess FROM bk")
def _(spark, d):
    return panels.books(scored(spark, d))


_NAMES = ("top", "low", "weighted", "inverse", "all_names")
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT date, '{x}' AS book, {x} AS ret FROM bk" for x in _NAMES) + ")"
_FIG = """e AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS eq FROM x WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, eq / greatest(1, max(eq) OVER (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM e),
g AS (SELECT {by}, count(*) AS days, arg_max(eq, date) AS last, min(dd) AS max_drawdown, avg(ret) AS m, stddev_samp(ret) AS s FROM dd GROUP BY {by})
SELECT {by}, days, pow(last, 252.0 / days) - 1 AS cagr, max_drawdown, CASE WHEN max_drawdown < 0 THEN (pow(last, 252.0 / days) - 1) / -max_drawdown END AS calmar, CASE WHEN days >= 5 AND s > 0 THEN m / s * sqrt(252) END AS sharpe FROM g"""


@query("pf07_pf08_figures_by_segment", f"WITH {_PANEL}, {_BOOKS}, {_LONG}, {SEGMENT_ROWS}, x AS (SELECT s.segment, l.* FROM l JOIN segments s ON l.date BETWEEN s.start_date AND s.end_date), " + _FIG.format(by="segment, book"))
def _(spark, d):
    return panels.figures_by_segment(panels.books(scored(spark, d)), views.segments(spark), list(_NAMES))


_SECTOR = f"""s0 AS (SELECT date, industry, avg(mom) AS mom, avg(amount_z) AS amount_z, avg(book_ret) AS book_ret, count(*) AS names FROM f JOIN industry USING (symbol) WHERE mom IS NOT NULL AND amount_z IS NOT NULL GROUP BY 1, 2),
s1 AS (SELECT *, count(*) OVER (PARTITION BY date) AS sectors FROM s0), s2 AS (SELECT *, {_SCORE} AS score FROM (SELECT * FROM s1 WHERE sectors >= 3))"""


@query("ag02_sector_scores", f"WITH {DAILY}, {_FACTORS}, {INDUSTRY}, {_SECTOR} SELECT date, industry, mom, amount_z, names, score FROM s2")
def _(spark, d):
    s = panels.sector_scores(panels.with_factors(views.daily(spark, d)), views.industry(spark, d))
    return s.select("date", "industry", "mom", "amount_z", "names", "score")


_TURN = """h AS (SELECT *, quantile_cont(score, 0.8) OVER (PARTITION BY date) AS hi FROM s2 WHERE score IS NOT NULL AND book_ret IS NOT NULL), p AS (SELECT date, industry, book_ret, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM h WHERE score >= hi),
d AS (SELECT date, lag(date) OVER (ORDER BY date) AS earlier FROM (SELECT DISTINCT date FROM p)), c AS (SELECT p.date, p.industry, p.weight AS now, 0.0 AS past FROM p JOIN d ON p.date = d.date AND d.earlier IS NOT NULL UNION ALL SELECT d.date, p.industry, 0.0, p.weight FROM p JOIN d ON p.date = d.earlier),
t AS (SELECT date, 0.5 * sum(abs(n - q)) AS turnover FROM (SELECT date, industry, sum(now) AS n, sum(past) AS q FROM c GROUP BY 1, 2) GROUP BY 1), r AS (SELECT date, avg(book_ret) AS top FROM p GROUP BY 1)
SELECT r.date, r.top, t.turnover, r.top - coalesce(t.turnover, 0) * 2 * 0.001 AS top_net FROM r LEFT JOIN t USING (date)"""


@query("pf04_sector_books_turnover", f"WITH {DAILY}, {_FACTORS}, {INDUSTRY}, {_SECTOR}, {_TURN}")
def _(spark, d):
    s = panels.sector_scores(panels.with_factors(views.daily(spark, d)), views.industry(spark, d)).where("score IS NOT NULL AND book_ret IS NOT NULL")
    day = Window.partitionBy("date")
    top = s.withColumn("hi", F.percentile("score", F.lit(0.8)).over(day)).where("score >= hi").select("date", "industry", "book_ret", (1 / F.count("*").over(day)).alias("weight"))
    books = top.groupBy("date").agg(F.avg("book_ret").alias("top"))
    out = books.join(panels.turnover(top.select("date", "industry", "weight"), "industry"), "date", "left")
    return out.withColumn("top_net", F.col("top") - F.coalesce("turnover", F.lit(0.0)) * 2 * 0.001)


_LEGS = "h AS (SELECT *, quantile_cont(score, 0.8) OVER (PARTITION BY date) AS hi, quantile_cont(score, 0.2) OVER (PARTITION BY date) AS lo FROM s2 WHERE score IS NOT NULL AND book_ret IS NOT NULL) SELECT date, avg(book_ret) FILTER (score >= hi) AS long_leg, avg(book_ret) FILTER (score <= lo) AS short_leg, avg(book_ret) FILTER (score >= hi) - avg(book_ret) FILTER (score <= lo) AS spread FROM h GROUP BY date"


@query("pf05_sector_long_short", f"WITH {DAILY}, {_FACTORS}, {INDUSTRY}, {_SECTOR}, {_LEGS}")
def _(spark, d):
    s = panels.sector_scores(panels.with_factors(views.daily(spark, d)), views.industry(spark, d)).where("score IS NOT NULL AND book_ret IS NOT NULL")
    day = Window.partitionBy("date")
    s = s.withColumns({"hi": F.percentile("score", F.lit(0.8)).over(day), "lo": F.percentile("score", F.lit(0.2)).over(day)})
    up, down = F.avg(F.when(F.col("score") >= F.col("hi"), F.col("book_ret"))), F.avg(F.when(F.col("score") <= F.col("lo"), F.col("book_ret")))
    return s.groupBy("date").agg(up.alias("long_leg"), down.alias("short_leg"), (up - down).alias("spread"))


_IC = """k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY mom) + (count(*) OVER (PARTITION BY date, mom) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS b FROM f WHERE mom IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT date, count(*) AS n, round(corr(a, b), 9) + 0.0 AS ic FROM k GROUP BY date HAVING count(*) >= 10)"""


@query("sk02_daily_ic_by_segment", f"WITH {DAILY}, {_FACTORS}, {_IC}, {SEGMENT_ROWS} SELECT segment, count(*) AS days, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_sd, avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS ir, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM ic JOIN segments ON date BETWEEN start_date AND end_date GROUP BY segment")
def _(spark, d):
    ic = panels.daily_ic(panels.with_factors(views.daily(spark, d)), "mom", "fwd")
    by = panels.in_segments(ic, views.segments(spark), F.col("date")).groupBy("segment")
    return by.agg(F.count("*").alias("days"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_sd"), (F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("*"))).alias("ir"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("positive"))


@query("tk03_quantile_members", f"WITH {_PANEL} SELECT date, symbol, CASE WHEN score >= hi THEN 'top' ELSE 'low' END AS side FROM (SELECT *, quantile_cont(score, 0.8) OVER (PARTITION BY date) AS hi, quantile_cont(score, 0.2) OVER (PARTITION BY date) AS lo FROM sc WHERE score IS NOT NULL) WHERE score >= hi OR score <= lo")
def _(spark, d):
    day = Window.partitionBy("date")
    rows = scored(spark, d).where("score IS NOT NULL").withColumns({"hi": F.percentile("score", F.lit(0.8)).over(day), "lo": F.percentile("score", F.lit(0.2)).over(day)})
    return rows.where("score >= hi OR score <= lo").select("date", "symbol", F.when(F.col("score") >= F.col("hi"), "top").otherwise("low").alias("side"))


@query("pf06_weekly_rebalance", f"""WITH {_PANEL}, w0 AS (SELECT date, symbol, book_ret, score, date_trunc('week', date) AS week FROM sc WHERE score IS NOT NULL), first AS (SELECT week, min(date) AS day FROM w0 GROUP BY 1),
q AS (SELECT w0.week, symbol, score, quantile_cont(score, 0.8) OVER (PARTITION BY w0.week) AS hi FROM w0 JOIN first ON w0.week = first.week AND w0.date = first.day), m AS (SELECT week, symbol FROM q WHERE score >= hi)
SELECT w0.date, avg(book_ret) AS ret, count(*) AS names FROM w0 JOIN m USING (week, symbol) WHERE book_ret IS NOT NULL GROUP BY w0.date""")
def _(spark, d):
    rows = scored(spark, d).where("score IS NOT NULL").select("date", "symbol", "book_ret", "score", F.date_trunc("week", "date").alias("week"))
    week = Window.partitionBy("week")
    chosen = rows.withColumn("day", F.min("date").over(week)).where("date = day").withColumn("hi", F.percentile("score", F.lit(0.8)).over(week)).where("score >= hi").select("week", "symbol")
    return rows.where("book_ret IS NOT NULL").join(chosen, ["week", "symbol"]).groupBy("date").agg(F.avg("book_ret").alias("ret"), F.count("*").alias("names"))
