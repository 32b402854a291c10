"""Holdings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.series import rounded
from barloom.operators import holdings as ph
from barloom.plans.base_sql import BARS, BENCH
from barloom.plans.registry import query
from barloom.plans.risk import staged_closes
from barloom.session import stage
from barloom.sources.market import benchmark, lots

END = "2001-12-31"


def staged_lots(spark, sf):
    """Purchases summed per (portfolio, symbol, day), written once for the branches that read them."""
    return stage(lots(spark, sf))


LOTS = f"""WITH {BARS}{BENCH}, lots AS MATERIALIZED (SELECT c_mktsegment AS portfolio, p_brand AS symbol, o_orderdate::DATE AS purchase_date, sum(l_quantity) AS shares,
    sum(l_quantity * (100 + 0.05 * sqrt(l_extendedprice / l_quantity))) AS cost
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 0 GROUP BY ALL)"""
VALUE = f"""{LOTS}, st AS (SELECT portfolio, min(purchase_date) AS start FROM lots GROUP BY portfolio), pr AS (SELECT DISTINCT portfolio, symbol, start FROM lots JOIN st USING (portfolio)),
  cal AS (SELECT DISTINCT portfolio, ts FROM pr JOIN bars USING (symbol) WHERE ts >= start),
  grid AS (SELECT cal.portfolio, cal.ts, symbol FROM cal JOIN pr USING (portfolio)),
  pb AS (SELECT portfolio, symbol, ts, close FROM bars JOIN pr USING (symbol) WHERE ts >= start),
  gp AS MATERIALIZED (SELECT g.portfolio, g.symbol, g.ts, b.close FROM grid g ASOF LEFT JOIN pb b ON b.portfolio = g.portfolio AND b.symbol = g.symbol AND b.ts <= g.ts),
  cl AS MATERIALIZED (SELECT portfolio, symbol, purchase_date::TIMESTAMP AS ts, sum(shares) OVER w AS shares, sum(cost) OVER w AS paid FROM lots WINDOW w AS (PARTITION BY portfolio, symbol ORDER BY purchase_date)),
  pos AS (SELECT g.*, l.shares, l.paid FROM gp g ASOF LEFT JOIN cl l ON l.portfolio = g.portfolio AND l.symbol = g.symbol AND l.ts <= g.ts),
  dv AS (SELECT portfolio, ts, sum(coalesce(shares * close, 0)) AS value, sum(coalesce(paid, 0)) AS paid FROM pos GROUP BY ALL),
  series AS MATERIALIZED (SELECT portfolio, ts, value, paid - coalesce(lag(paid) OVER (PARTITION BY portfolio ORDER BY ts), 0) AS flow FROM dv)"""

@query("ph_value_series", f"{VALUE} SELECT portfolio, ts, round(value, 2) AS value, round(flow, 2) AS flow FROM series")
def _(spark, sf):
    return rounded(ph.value_series(staged_lots(spark, sf), staged_closes(spark, sf)), 2)


TWR = """twr AS (SELECT portfolio, (product(1 + (value - b - flow) / b) FILTER (b > 0) - 1) * 100 AS twr_pct, count(*) AS days
  FROM (SELECT *, lag(value) OVER (PARTITION BY portfolio ORDER BY ts) AS b FROM series) GROUP BY portfolio)"""


@query("ph_time_weighted", f"{VALUE}, {TWR} SELECT portfolio, round(twr_pct, 4) AS twr_pct, days FROM twr")
def _(spark, sf):
    return rounded(ph.time_weighted(ph.value_series(staged_lots(spark, sf), staged_closes(spark, sf))), 4)


MWR = f"""fin AS (SELECT portfolio, arg_max(value, ts) AS value FROM series GROUP BY portfolio),
  fl AS MATERIALIZED (SELECT portfolio, date_diff('day', first, d) / 365.25::DOUBLE AS t, a FROM (
    SELECT portfolio, purchase_date AS d, -sum(cost) AS a FROM lots GROUP BY ALL UNION ALL SELECT portfolio, DATE '{END}', value FROM fin)
    JOIN (SELECT portfolio, min(purchase_date) AS first FROM lots GROUP BY portfolio) USING (portfolio)),
  fa AS MATERIALIZED (SELECT portfolio, list(t) AS ts, list(a) AS am, sum(a / pow(1 - 0.9999::DOUBLE, t)) AS lo_npv, sum(a / pow(11::DOUBLE, t)) AS hi_npv FROM fl GROUP BY portfolio),
  mwr AS (WITH RECURSIVE b(portfolio, k, lo, hi) AS (SELECT portfolio, 0, -0.9999::DOUBLE, 10::DOUBLE FROM fa UNION ALL
      SELECT portfolio, k + 1, CASE WHEN npv * lo_npv > 0 THEN mid ELSE lo END, CASE WHEN npv * lo_npv > 0 THEN hi ELSE mid END FROM (
        SELECT b.*, (lo + hi) / 2 AS mid, lo_npv, list_sum(list_transform(list_zip(am, ts), lambda z: z[1] / pow(1 + (lo + hi) / 2, z[2]))) AS npv
        FROM b JOIN fa USING (portfolio) WHERE k < 80))
    SELECT b.portfolio, CASE WHEN lo_npv * hi_npv <= 0 THEN (lo + hi) / 2 * 100 END AS mwr_pct FROM b JOIN fa USING (portfolio) WHERE k = 80)"""


@query("ph_money_weighted", f"{VALUE}, {MWR} SELECT portfolio, round(mwr_pct, 5) AS mwr_pct FROM mwr")
def _(spark, sf):
    owned = staged_lots(spark, sf)
    series = ph.value_series(owned, staged_closes(spark, sf))
    final = series.groupBy("portfolio").agg(F.max_by("value", "ts").alias("value"))
    return rounded(ph.money_weighted(owned, final.withColumn("end", F.lit(END).cast("date"))), 5)


@query("ph_rebased_benchmark", f"""{VALUE}, j AS (SELECT s.portfolio, s.ts, s.value, last_value(bench IGNORE NULLS) OVER w AS f FROM series s LEFT JOIN bench USING (ts) WINDOW w AS (PARTITION BY portfolio ORDER BY ts)),
  k AS (SELECT portfolio, ts, value, coalesce(f, first_value(f IGNORE NULLS) OVER (PARTITION BY portfolio ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f FROM j)
  SELECT portfolio, ts, round(value, 2) AS value, round(f / first_value(f) OVER w * first_value(value) OVER w, 4) AS benchmark FROM k WINDOW w AS (PARTITION BY portfolio ORDER BY ts)""")
def _(spark, sf):
    daily = staged_closes(spark, sf)
    return rounded(ph.rebased_benchmark(ph.value_series(staged_lots(spark, sf), daily), benchmark(daily)), 4, value=2)


@query("ph_lot_performance", f"""{LOTS}, l AS (SELECT symbol, arg_max(close, ts) AS price FROM bars GROUP BY symbol)
  SELECT portfolio, symbol, purchase_date::TIMESTAMP AS purchase_ts, round(shares, 4) AS shares, round(cost, 4) AS cost, round(shares * price, 4) AS market_value,
    round(shares * price - cost, 4) AS gain, round((shares * price - cost) / cost * 100, 5) AS gain_pct,
    CASE WHEN purchase_date > DATE '2001-06-30' THEN 'purchase date is in the future' ELSE '' END AS problems FROM lots LEFT JOIN l USING (symbol)""")
def _(spark, sf):
    checked = ph.valid_lots(staged_lots(spark, sf), F.lit("2001-06-30").cast("date"))
    out = ph.lot_performance(checked, staged_closes(spark, sf)).withColumn("purchase_ts", F.col("purchase_date").cast("timestamp_ntz"))
    return rounded(out.select("portfolio", "symbol", "purchase_ts", "shares", "cost", "market_value", "gain", "gain_pct", "problems"), 4, gain_pct=5)


@query("ph_performance", f"""{VALUE}, {TWR}, {MWR}, l AS (SELECT symbol, arg_max(close, ts) AS price FROM bars GROUP BY symbol),
  t AS (SELECT portfolio, count(*) AS priced_lots, sum(shares * price) AS mv, sum(cost) AS cost FROM lots JOIN l USING (symbol) GROUP BY portfolio),
  m AS (SELECT portfolio, (arg_max(bench, ts) / arg_min(bench, ts) - 1) * 100 AS bp FROM series JOIN bench USING (ts) GROUP BY portfolio)
  SELECT portfolio, priced_lots, round(mv, 2) AS market_value, round(cost, 2) AS cost, round(mv - cost, 2) AS gain, round((mv - cost) / cost * 100, 5) AS gain_pct, round(twr_pct, 4) AS twr_pct, days,
    round(mwr_pct, 4) AS mwr_pct, round(bp, 4) AS benchmark_pct, round(twr_pct - bp, 4) AS excess_pct FROM t JOIN twr USING (portfolio) JOIN mwr USING (portfolio) JOIN m USING (portfolio)""")
def _(spark, sf):
    daily = staged_closes(spark, sf)
    out = ph.performance(staged_lots(spark, sf), daily, benchmark(daily), F.lit(END).cast("date"))
    return rounded(out.drop("note", "excluded_lots"), 4, market_value=2, cost=2, gain=2, gain_pct=5)
