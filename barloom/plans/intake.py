"""Source and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.series import rounded
from barloom.operators import clean as cl
from barloom.plans.base_sql import BARS, BENCH
from barloom.plans.registry import query
from barloom.sources import payloads as pl
from barloom.sources.companies import statements, yearly
from barloom.sources.market import bars_daily, brand_number, macro_bundle
from barloom.sources.tables import bars_between, bars_of, table


def dirty_bars(spark, sf):
    """Daily bars with duplicates and impossible rows put in by a rule on day and brand number."""
    n = F.datediff("ts", F.lit("1995-01-01").cast("date")) * 25 + brand_number()
    base = bars_daily(spark, sf).withColumn("_n", n)
    swap = F.col("_n") % 89 == 0
    base = base.select(
        "symbol", "ts", "open", F.when(swap, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", "close", "volume",
        F.when(F.col("_n") % 83 == 0, F.lit(None)).otherwise(F.col("close")).alias("adj_close"), "_n")
    copies = F.explode(F.when(F.col("_n") % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    out = base.withColumn("ingest_id", copies)
    return out.withColumn("adj_close", F.col("adj_close") + (F.col("ingest_id") - 1) * 0.01).drop("_n")


DIRTY = f"""{BARS}, db AS (SELECT *, date_diff('day', TIMESTAMP '1995-01-01', ts) * 25 + regexp_extract(symbol, '([0-9]+)', 1)::INT AS n FROM bars),
  mk AS MATERIALIZED (SELECT symbol, ts, open, CASE WHEN n % 89 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN n % 83 <> 0 THEN close END AS close, volume, CASE WHEN n % 97 = 0 THEN 2 ELSE 1 END AS copies FROM db),
  vd AS MATERIALIZED (SELECT *, coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND high >= low AND open BETWEEN low AND high AND close BETWEEN low AND high, false) AS valid FROM mk),
  g0 AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS previous FROM vd WHERE valid),
  g1 AS (SELECT *, epoch_us(ts) - epoch_us(previous) AS spacing FROM g0),
  g2 AS (SELECT symbol, quantile_cont(spacing, 0.5) AS typical, count(*) AS n FROM g1 GROUP BY symbol),
  gaps AS MATERIALIZED (SELECT symbol, previous, ts, floor(spacing / 86400000000)::BIGINT AS days, floor(typical / 86400000000)::BIGINT AS typical_days FROM g1 JOIN g2 USING (symbol) WHERE n >= 3 AND typical > 0 AND spacing > 5 * typical)"""


@query("cl_clean_bars", f"WITH {DIRTY} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM vd WHERE valid")
def _(spark, sf):
    return rounded(cl.clean(dirty_bars(spark, sf)))


@query("cl_gaps", f"WITH {DIRTY} SELECT * FROM gaps")
def _(spark, sf):
    return cl.gaps(cl.clean(dirty_bars(spark, sf)))


@query("cl_audit", f"""WITH {DIRTY}, c AS (SELECT symbol, sum(copies - 1)::BIGINT AS duplicates, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (valid) AS bars FROM vd GROUP BY symbol),
  g AS (SELECT symbol, count(*) AS gaps FROM gaps GROUP BY symbol)
  SELECT symbol, duplicates, invalid, bars, coalesce(gaps, 0) AS gaps, duplicates + invalid + coalesce(gaps, 0) AS issues, duplicates + invalid + coalesce(gaps, 0) = 0 AS is_clean FROM c LEFT JOIN g USING (symbol)""")
def _(spark, sf):
    return cl.audit(dirty_bars(spark, sf))


@query("src_bars_range", f"""WITH {BARS} SELECT symbol, ts, round(close, 6) AS close FROM bars WHERE symbol IN ('Brand#3', 'Brand#7') AND ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1999-01-01'""")
def _(spark, sf):
    out = bars_between(bars_daily(spark, sf, "1997-01-01", "1999-01-01"), ["Brand#3", "Brand#7"])
    return rounded(out.select("symbol", "ts", "close"))


@query("src_bars_of_symbols", f"""WITH {BARS} SELECT symbol, count(*) AS bars, max(ts) AS last_ts FROM bars WHERE symbol IN (SELECT p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size > 45) GROUP BY symbol""")
def _(spark, sf):
    keys = table(spark, sf, "part").where((F.col("p_type") == "ECONOMY") & (F.col("p_size") > 45)).select(F.col("p_brand").alias("symbol"))
    return bars_of(bars_daily(spark, sf), keys).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("ts").alias("last_ts"))


def chart_payloads(spark, sf):
    """One price message per event."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    pair = lambda v: F.array(F.array(ms, v.cast("double")))
    body = F.to_json(F.struct(pair(F.col("value")).alias("prices"), pair(F.col("event_id") % 1000).alias("total_volumes")))
    return table(spark, sf, "events").select(F.concat(F.lit("crypto:"), F.col("event_type")).alias("symbol"), body.alias("body"))


@query("src_chart_daily", """WITH e AS (SELECT 'crypto:' || event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS d, epoch_ms(ts) AS ms, value, (event_id % 1000)::DOUBLE AS v FROM events),
  b AS (SELECT symbol, d AS ts, arg_max(value, (ms, value)) AS close, arg_max(v, (ms, v)) AS volume FROM e GROUP BY ALL)
  SELECT symbol, ts, close AS open, close AS high, close AS low, close, volume FROM b""")
def _(spark, sf):
    return pl.daily_from_chart(chart_payloads(spark, sf))


@query("src_asset_profiles", """SELECT 'crypto:' || c_custkey AS symbol, lower(trim(c_custkey::VARCHAR)) AS coin, c_name AS long_name, upper(c_mktsegment) AS code, c_acctbal AS quote_price,
  round(c_acctbal - (c_custkey % 7)::DOUBLE, 6) AS previous_close, round(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal * 1000 END, 6) AS market_cap FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    body = F.to_json(F.struct(
        F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("symbol"), F.struct(
            F.struct(F.col("c_acctbal").alias("usd")).alias("current_price"), (F.col("c_custkey") % 7).cast("double").alias("price_change_24h"),
            F.struct(F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") * 1000).alias("usd")).alias("market_cap")).alias("market_data")))
    raw = c.select(F.concat(F.lit("crypto:"), F.col("c_custkey").cast("string")).alias("symbol"), body.alias("body"))
    out = pl.asset_profiles(raw).withColumn("coin", pl.coin_id(F.col("symbol")))
    return rounded(out, 6)


@query("src_load_status", """WITH s AS (SELECT 'S' || s_suppkey AS symbol, s_acctbal FROM supplier), st AS (SELECT DISTINCT 'S' || l_suppkey AS symbol FROM lineitem), h AS (SELECT DISTINCT 'S' || l_suppkey AS symbol FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.08)
  SELECT s.symbol, CASE WHEN h.symbol IS NULL THEN 'no holders' ELSE '' END AS warnings, CASE WHEN st.symbol IS NULL THEN 'no statements' END AS error FROM s LEFT JOIN st USING (symbol) LEFT JOIN h USING (symbol)""")
def _(spark, sf):
    symbols = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    lines = table(spark, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), "l_returnflag", "l_quantity", "l_discount")
    holders = lines.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49) & (F.col("l_discount") > 0.08))
    return pl.load_status(symbols, {"statements": lines, "holders": holders}, "statements")


@query("src_statement_symbols", "SELECT DISTINCT 'S' || l_suppkey AS symbol, make_date(year(l_shipdate), 12, 31)::TIMESTAMP AS period FROM lineitem")
def _(spark, sf):
    out = statements(yearly(spark, sf)).select("symbol", F.col("period_end").cast("timestamp_ntz").alias("period"))
    return out.distinct()


@query("src_macro_bundle", f"""WITH {BARS}{BENCH}, e AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, arg_max(100 + 0.5 * sqrt(value), epoch_us(events.ts) % 86400000000 * 67108864 + event_id % 67108864) AS c FROM events WHERE event_type IN ('error', 'view') GROUP BY ALL),
  s AS (SELECT ts, max(c) FILTER (event_type = 'error') AS fear, max(c) FILTER (event_type = 'view') AS yield FROM e GROUP BY ts)
  SELECT ts, round(bench, 6) AS benchmark, round(fear, 6) AS fear, round(yield, 6) AS yield FROM bench FULL JOIN s USING (ts)""")
def _(spark, sf):
    return rounded(macro_bundle(spark, sf))


@query("src_provider_union", f"""WITH {BARS}, e AS (SELECT 'crypto:' || event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_max(value, epoch_ms(ts)) AS close FROM events GROUP BY ALL)
  SELECT symbol, 'primary' AS provider, count(*) AS bars, count(volume) AS with_volume FROM bars GROUP BY symbol UNION ALL SELECT symbol, 'chart', count(*), 0 FROM e GROUP BY symbol""")
def _(spark, sf):
    other = pl.daily_from_chart(chart_payloads(spark, sf)).drop("volume")
    both = pl.with_provider(bars_daily(spark, sf), other, "chart")
    return both.groupBy("symbol", "provider").agg(F.count(F.lit(1)).alias("bars"), F.count("volume").alias("with_volume"))
