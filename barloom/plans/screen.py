"""Screens, percentiles, peers, preferences, ownership, seasonality, quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import latest, rounded
from barloom.operators import fundamentals as fa
from barloom.operators import indicators as ti
from barloom.operators import portfolio as pa
from barloom.operators import risk as rk
from barloom.operators import screen as sc
from barloom.plans.base_sql import BARS, MEMBERS, RETURNS, RSI_CTE
from barloom.plans.company_sql import ANALYZED, BRAND_ANALYZED, COMPANY, PROFILE, YEARLY
from barloom.plans.fundamentals import analyzed, company_tables, standardized
from barloom.plans.registry import query
from barloom.plans.risk import METRICS, staged_closes
from barloom.sources.bars import bars_from_bars
from barloom.sources.companies import profiles, yearly
from barloom.sources.market import bars_daily, baskets, brand_number
from barloom.sources.tables import table

CRITERIA = (
    ("quality", "pe_ratio", "<=", 40.0), ("quality", "roe_pct", ">", 5.0), ("quality", "altman_z", ">=", 1.81),
    ("trend", "rsi", "<", 55.0), ("trend", "sharpe_ratio", ">", -1.0), ("trend", "max_drawdown_pct", ">=", -30.0),
    ("trend", "annual_volatility_pct", "<", 80.0), ("mixed", "debt_to_equity", "<", 1.5), ("mixed", "sortino_ratio", ">", -2.0),
    ("mixed", "current_ratio", ">", 1.0), ("mixed", "net_margin_pct", ">=", 0.0),
)


def brand_analyzed(spark, sf, daily=None):
    periods, profile = company_tables(spark, sf, "brand")
    daily = staged_closes(spark, sf) if daily is None else daily
    last = daily.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close"))
    return fa.ratios(fa.standardize(periods, profile, last))


def risk_inputs(spark, sf, daily=None):
    """Fundamental and risk columns of every brand, one row each."""
    daily = staged_closes(spark, sf) if daily is None else daily
    prices = rk.risk_metrics(daily).drop("bars", "last_close", "n_returns")
    return brand_analyzed(spark, sf, daily).join(prices, "symbol", "left")


def full_metrics(spark, sf, daily=None):
    """Fundamental, risk and indicator metrics of every brand, one row each."""
    daily = staged_closes(spark, sf) if daily is None else daily
    last_rsi = latest(ti.rsi(daily).select("symbol", "ts", "rsi")).select("symbol", "rsi")
    return risk_inputs(spark, sf, daily).join(last_rsi, "symbol", "left")


CRIT_SQL = "crit AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{m}', '{o}', {t}::DOUBLE)" for s, m, o, t in CRITERIA) + ") c(screen_id, metric, op, threshold))"
_M = {**sc.SHALLOW, **sc.DEEP, **sc.PRICE}
LONG_SQL = "lm AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT symbol, '{m}' AS metric, ({e})::DOUBLE AS value FROM wide" for m, e in _M.items()) + ")"
WIDE_SQL = f"""{RETURNS}, {RSI_CTE}, {METRICS}, {BRAND_ANALYZED}, wide AS MATERIALIZED (SELECT an.*, rsi, m.sharpe, m.sortino, m.ann_vol, m.max_drawdown, m.hist_var, m.expected_shortfall, m.rolling_vol, m.calmar, m.bars
  FROM an LEFT JOIN metrics m USING (symbol) LEFT JOIN (SELECT symbol, arg_max(rsi, ts) AS rsi FROM rsi GROUP BY symbol) USING (symbol))"""
CMP = "CASE op WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold END"


@query("sc_run_screen", f"""WITH {WIDE_SQL}, {LONG_SQL}, {CRIT_SQL}, t AS (SELECT *, {CMP} AS passed FROM lm JOIN crit USING (metric)),
  g AS (SELECT screen_id, symbol, count(*) AS criteria, count(passed) AS evaluable, count(*) FILTER (passed) AS passes, coalesce(string_agg(metric, ', ' ORDER BY metric) FILTER (passed IS NULL), '') AS missing FROM t GROUP BY ALL)
  SELECT *, CASE WHEN evaluable < criteria THEN 'undecided' WHEN passes = criteria THEN 'passed' ELSE 'failed' END AS passed_all, CASE WHEN evaluable = criteria THEN 'ok' ELSE 'insufficient_data' END AS status FROM g""")
def _(spark, sf):
    used = {m for _, m, _, _ in CRITERIA}
    metrics = sc.long_metrics(full_metrics(spark, sf), {m: e for m, e in _M.items() if m in used})
    criteria = spark.createDataFrame(CRITERIA, "screen_id string, metric string, op string, threshold double")
    return sc.run_screen(metrics, criteria)


REQ_SQL = """req AS (SELECT DISTINCT unnest(['quality', 'trend', 'mixed', 'empty']) AS screen_id, p_brand AS symbol, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS n FROM part),
  asked AS MATERIALIZED (SELECT screen_id, symbol FROM req WHERE (n + length(screen_id)) % 3 > 0 UNION ALL SELECT DISTINCT screen_id, 'Brand#none' FROM req)"""


@query("sc_run_requests", f"""WITH {WIDE_SQL}, {LONG_SQL}, {CRIT_SQL}, {REQ_SQL}, t AS (SELECT screen_id, a.symbol, c.metric, {CMP} AS passed, w.symbol IS NOT NULL AS known
    FROM asked a LEFT JOIN crit c USING (screen_id) LEFT JOIN lm ON lm.symbol = a.symbol AND lm.metric = c.metric LEFT JOIN wide w ON w.symbol = a.symbol),
  g AS (SELECT screen_id, symbol, count(metric) AS criteria, count(passed) AS evaluable, count(*) FILTER (passed) AS passes, coalesce(string_agg(metric, ', ' ORDER BY metric) FILTER (passed IS NULL AND metric IS NOT NULL), '') AS missing, bool_and(known) AS k FROM t GROUP BY ALL)
  SELECT screen_id, symbol, criteria, evaluable, passes, missing, CASE WHEN criteria = 0 THEN NULL WHEN evaluable < criteria THEN 'undecided' WHEN passes = criteria THEN 'passed' ELSE 'failed' END AS passed_all,
    CASE WHEN NOT k THEN 'fetch_error' WHEN evaluable = criteria THEN 'ok' ELSE 'insufficient_data' END AS status FROM g""")
def _(spark, sf):
    used = {m for _, m, _, _ in CRITERIA}
    metrics = sc.long_metrics(full_metrics(spark, sf), {m: e for m, e in _M.items() if m in used})
    criteria = spark.createDataFrame(CRITERIA, "screen_id string, metric string, op string, threshold double")
    names = table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), brand_number("p_brand").alias("n")).distinct()
    screens = F.array(*[F.lit(s) for s in ("quality", "trend", "mixed", "empty")])
    asked = names.withColumn("screen_id", F.explode(screens)).where((F.col("n") + F.length("screen_id")) % 3 > 0).select("screen_id", "symbol")
    unknown = names.withColumn("screen_id", F.explode(screens)).select("screen_id", F.lit("Brand#none").alias("symbol")).distinct()
    return sc.run_requests(metrics, criteria, asked.union(unknown))


_PCT = {m: ("return_on_equity" if m == "roe" else m) for m in sc.PERCENTILE_METRICS}


@query("sc_sector_percentiles", f"""WITH {COMPANY}, l AS ({' UNION ALL '.join(f"SELECT symbol, sector, '{m}' AS metric, {e} AS value FROM std" for m, e in _PCT.items())}),
  l2 AS MATERIALIZED (SELECT * FROM l WHERE sector IS NOT NULL), mb AS (SELECT sector, count(DISTINCT symbol) AS members FROM l2 GROUP BY sector),
  p AS (SELECT a.symbol, a.sector, a.metric, a.value, count(b.value) FILTER (b.symbol <> a.symbol) AS peers, count(*) FILTER (b.symbol <> a.symbol AND b.value < a.value) AS lt,
    count(*) FILTER (b.symbol <> a.symbol AND b.value <= a.value) AS le FROM l2 a JOIN l2 b USING (sector, metric) GROUP BY ALL),
  q AS (SELECT symbol, sector, metric, value, CASE WHEN value IS NOT NULL AND peers >= 3 THEN (lt + le) / (2 * peers)::DOUBLE * 100 END AS pct FROM p JOIN mb USING (sector) WHERE members - 1 >= 3)
  SELECT symbol, sector, metric, round(value, 6) AS value, round(pct, 6) AS percentile, CASE WHEN pct IS NULL THEN 'N/A' ELSE round_even(pct, 0)::BIGINT || CASE WHEN round_even(pct, 0)::BIGINT % 100 BETWEEN 11 AND 13 THEN 'th'
    WHEN round_even(pct, 0)::BIGINT % 10 = 1 THEN 'st' WHEN round_even(pct, 0)::BIGINT % 10 = 2 THEN 'nd' WHEN round_even(pct, 0)::BIGINT % 10 = 3 THEN 'rd' ELSE 'th' END || ' percentile' END AS label FROM q""")
def _(spark, sf):
    long = sc.long_metrics(standardized(spark, sf), _PCT, ("symbol", "sector"))
    out = sc.sector_percentiles(long)
    return rounded(out.withColumn("label", sc.percentile_text(F.col("percentile"))))


_PEER = {m: (f"{m} * 100" if m in ("return_on_equity", "net_margin", "earnings_growth") else m) for m, _ in sc.PEER_METRICS}
HIGHER = "metric IN ('return_on_equity', 'net_margin', 'earnings_growth', 'momentum_pct')"
PEERS = f"""{BARS}, {BRAND_ANALYZED}{MEMBERS}, pm AS (SELECT a.*, (last_close / first_close - 1) * 100 AS momentum_pct, basket AS peer_group FROM an a JOIN mem USING (symbol) LEFT JOIN lc USING (symbol)
    LEFT JOIN (SELECT symbol, arg_min(close, ts) AS first_close FROM bars GROUP BY symbol) USING (symbol)),
  pl AS MATERIALIZED ({' UNION ALL '.join(f"SELECT peer_group, symbol, '{m}' AS metric, ({e})::DOUBLE AS value FROM pm" for m, e in _PEER.items())}),
  pa AS (SELECT *, avg(value) OVER (PARTITION BY peer_group, metric) AS average FROM pl),
  pf2_ AS (SELECT *, (value - average) / nullif(abs(average), 0) * 100 AS d FROM pa),
  flags AS MATERIALIZED (SELECT *, CASE WHEN d IS NULL THEN 'unavailable' WHEN abs(d) < 10 THEN 'in_line' WHEN ({HIGHER} AND d > 0) OR (NOT {HIGHER} AND d < 0) THEN 'outperform' ELSE 'laggard' END AS flag FROM pf2_)"""


def peer_frame(spark, sf):
    daily = staged_closes(spark, sf)
    mom = pa.momentum(daily).select("symbol", (F.col("momentum") * 100).alias("momentum_pct"))
    groups = baskets(spark, sf).select("symbol", F.col("basket").alias("peer_group"))
    return brand_analyzed(spark, sf, daily).join(groups, "symbol").join(mom, "symbol", "left")


def peer_flags(spark, sf):
    long = sc.long_metrics(peer_frame(spark, sf), _PEER, ("peer_group", "symbol"))
    higher = F.col("metric").isin([m for m, h in sc.PEER_METRICS if h])
    return sc.group_averages(long).withColumn("flag", sc.flag_metric(F.col("value"), F.col("average"), higher))


@query("sc_peer_flags", f"WITH {PEERS} SELECT peer_group, symbol, metric, round(value, 5) AS value, round(average, 5) AS average, flag FROM flags")
def _(spark, sf):
    return rounded(peer_flags(spark, sf).select("peer_group", "symbol", "metric", "value", "average", "flag"), 5)


@query("sc_benchmark_rows", f"""WITH {PEERS}, g AS (SELECT peer_group, symbol, count(*) FILTER (flag = 'outperform') AS outperform, count(*) FILTER (flag = 'laggard') AS laggard,
    count(*) FILTER (flag <> 'unavailable') AS evaluable FROM flags GROUP BY ALL)
  SELECT *, CASE WHEN evaluable = 0 THEN 'Not Enough Data' WHEN outperform >= evaluable / 2 + 1 THEN 'Outperformer' WHEN laggard >= evaluable / 2 + 1 THEN 'Laggard' ELSE 'Mixed' END AS verdict FROM g""")
def _(spark, sf):
    return sc.benchmark_rows(peer_flags(spark, sf))


_RADAR = {"pe_ratio": "pe_ratio", "price_to_book": "price_to_book", "debt_to_equity": "debt_to_equity", "roe_pct": "return_on_equity * 100", "net_margin_pct": "net_margin * 100", "growth_pct": "earnings_growth * 100", "momentum_pct": "momentum_pct"}


@query("sc_radar", f"""WITH {PEERS}, rl AS ({' UNION ALL '.join(f"SELECT peer_group, symbol, '{m}' AS metric, ({e})::DOUBLE AS value, {str(dict(sc.RADAR_METRICS)[m]).lower()} AS higher FROM pm WHERE pe_ratio IS NOT NULL OR net_margin IS NOT NULL" for m, e in _RADAR.items())}),
  rs AS (SELECT *, avg(value) OVER w AS a, min(value) OVER w AS lo, max(value) OVER w AS hi FROM rl WINDOW w AS (PARTITION BY peer_group, metric))
  SELECT peer_group, symbol, metric, round(CASE WHEN lo = hi THEN 50 WHEN higher THEN (coalesce(value, a) - lo) / (hi - lo) * 100 ELSE 100 - (coalesce(value, a) - lo) / (hi - lo) * 100 END, 5) AS score FROM rs""")
def _(spark, sf):
    frame = peer_frame(spark, sf).where(F.col("pe_ratio").isNotNull() | F.col("net_margin").isNotNull())
    long = sc.long_metrics(frame, _RADAR, ("peer_group", "symbol"))
    return rounded(sc.radar(long.withColumn("higher", F.col("metric").isin([m for m, h in sc.RADAR_METRICS if h]))), 5)


@query("sc_basket_cards", f"""WITH {COMPANY}, w AS (SELECT symbol, sector AS basket, ((net_margin >= 0.10)::INT + coalesce((debt_to_equity > 0 AND debt_to_equity < 1)::INT, 0) + coalesce((current_ratio > 1.2)::INT, 0) + (pe_ratio BETWEEN 15 AND 45)::INT) / 4::DOUBLE * 100 AS score
    FROM std WHERE nullif(pe_ratio, 0) IS NOT NULL AND nullif(net_margin, 0) IS NOT NULL AND sector IS NOT NULL)
  SELECT basket, symbol, score, row_number() OVER (PARTITION BY basket ORDER BY score DESC, symbol) AS rank FROM w QUALIFY rank <= 4""")
def _(spark, sf):
    scores = fa.watch_score(standardized(spark, sf)).where(F.col("sector").isNotNull())
    return sc.top_cards(scores.select(F.col("sector").alias("basket"), "symbol", "score"))


def preferences(spark, sf):
    """Preferences of every customer, spread over the profiles by key."""
    k = F.col("c_custkey")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), pick(["Conservative", "Balanced", "Aggressive"]).alias("risk_profile"),
        F.element_at(F.array(F.lit("Any"), F.lit("Value-leaning"), F.lit("Growth-leaning")), (F.floor(k / 3) % 3 + 1).cast("int")).alias("valuation"),
        (k % 4 != 0).alias("require_profitable"),
        F.when(k % 5 == 0, F.array(F.lit("Energy"), F.lit("Utilities"))).otherwise(F.array().cast("array<string>")).alias("sectors"))


def _suggestions_sql(source: str, table: str, volatility: bool) -> str:
    """Criteria of every user against the companies of ``table``; the volatility criterion needs prices."""
    more = " UNION ALL SELECT user_id, sec, 'annual_volatility_pct', '<=', round(30 * m, 2) FROM us" if volatility else ""
    value = f" UNION ALL SELECT symbol, sector, 'annual_volatility_pct', ann_vol * 100 FROM {table}" if volatility else ""
    return f"""WITH {source}, us AS (SELECT c_custkey AS user_id, [0.7, 1.0, 1.6][c_custkey % 3 + 1]::DOUBLE AS m, (c_custkey // 3) % 3 AS v, c_custkey % 4 <> 0 AS prof, c_custkey % 5 = 0 AS sec FROM customer),
  cr AS (SELECT user_id, sec, 'beta' AS metric, '<=' AS op, round(1.5 * m, 2) AS threshold FROM us UNION ALL SELECT user_id, sec, 'debt_to_equity', '<=', round(2.5 * m, 2) FROM us{more} UNION ALL SELECT user_id, sec, 'altman_z', '>=', round(1.81 / m, 2) FROM us
    UNION ALL SELECT user_id, sec, 'net_margin_pct', '>=', round(10 / m, 2) FROM us WHERE prof UNION ALL SELECT user_id, sec, 'current_ratio', '>=', round(1 / m, 2) FROM us UNION ALL SELECT user_id, sec, 'pe_ratio', '<=', 27 FROM us WHERE v = 1
    UNION ALL SELECT user_id, sec, 'price_to_book', '<=', 4 FROM us WHERE v = 1 UNION ALL SELECT user_id, sec, 'peg_ratio', '<=', 2.5 FROM us WHERE v = 2),
  lm AS (SELECT symbol, sector, 'beta' AS metric, beta AS value FROM {table} UNION ALL SELECT symbol, sector, 'debt_to_equity', debt_to_equity FROM {table} UNION ALL SELECT symbol, sector, 'altman_z', altman_z FROM {table} UNION ALL SELECT symbol, sector, 'net_margin_pct', net_margin * 100 FROM {table}
    UNION ALL SELECT symbol, sector, 'current_ratio', current_ratio FROM {table} UNION ALL SELECT symbol, sector, 'pe_ratio', pe_ratio FROM {table} UNION ALL SELECT symbol, sector, 'price_to_book', price_to_book FROM {table} UNION ALL SELECT symbol, sector, 'peg_ratio', peg_ratio FROM {table}{value}),
  t AS (SELECT user_id, symbol, {CMP} AS passed FROM lm JOIN cr USING (metric) WHERE NOT sec OR sector IN ('Energy', 'Utilities')),
  g AS (SELECT user_id, symbol, count(passed) AS n, count(*) FILTER (passed) AS k FROM t GROUP BY ALL HAVING count(passed) >= 3),
  w AS (SELECT *, k / n::DOUBLE AS p, greatest(0, ((k / n::DOUBLE) + 1 / (2.0::DOUBLE * n) - sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 1 / (4.0::DOUBLE * n * n))) / (1 + 1 / n::DOUBLE)) * 100 AS c FROM g)
  SELECT user_id, symbol, n AS evaluable, k AS matched, round(p * 100, 5) AS match_pct, round(c, 5) AS confidence_pct, row_number() OVER (PARTITION BY user_id ORDER BY round(c, 9) DESC, n DESC, symbol) AS rank FROM w QUALIFY rank <= 10"""


@query("sc_suggestions", _suggestions_sql(ANALYZED, "an", False))
def _(spark, sf):
    """Companies that are not traded: the volatility criterion cannot be evaluated for them and leaves both sides of the score."""
    sets, users = sc.fold_users(preferences(spark, sf))
    wanted = {m: e for m, e in {**sc.SHALLOW, **sc.DEEP}.items() if m != "roe_pct"}
    long = sc.long_metrics(analyzed(spark, sf), wanted, ("symbol", "sector"))
    best = sc.suggestions(long, sc.preference_criteria(sets)).withColumnRenamed("user_id", "set_id")
    out = users.join(best, "set_id").drop("set_id")
    return rounded(out, 5)


@query("sc_suggestions_priced", _suggestions_sql(WIDE_SQL, "wide", True))
def _(spark, sf):
    """Traded companies, judged by all tiers of metrics."""
    sets, users = sc.fold_users(preferences(spark, sf))
    wanted = {m: e for m, e in {**sc.SHALLOW, **sc.DEEP, **sc.PRICE}.items() if m in (
        "beta", "debt_to_equity", "altman_z", "net_margin_pct", "current_ratio", "pe_ratio", "price_to_book", "peg_ratio", "annual_volatility_pct")}
    long = sc.long_metrics(risk_inputs(spark, sf), wanted, ("symbol", "sector"))
    best = sc.suggestions(long, sc.preference_criteria(sets)).withColumnRenamed("user_id", "set_id")
    return rounded(users.join(best, "set_id").drop("set_id"), 5)


@query("sc_available_sectors", f"WITH {YEARLY}, {PROFILE} SELECT DISTINCT sector FROM profile WHERE sector IS NOT NULL AND sector <> '' ORDER BY sector")
def _(spark, sf):
    return profiles(yearly(spark, sf)).where(F.coalesce("sector", F.lit("")) != "").select("sector").distinct().orderBy("sector")


@query("sc_ownership", f"""WITH {YEARLY}, {PROFILE} SELECT symbol, round(held_pct_insiders * 100, 5) AS insiders_pct, round(held_pct_institutions * 100, 5) AS institutions_pct,
  round(CASE WHEN held_pct_insiders IS NOT NULL AND held_pct_institutions IS NOT NULL THEN greatest(0, 100 - held_pct_insiders * 100 - held_pct_institutions * 100) END, 5) AS public_pct FROM profile""")
def _(spark, sf):
    return rounded(sc.ownership(profiles(yearly(spark, sf))), 5)


@query("sc_top_holders", """WITH h AS (SELECT 'S' || l_suppkey AS symbol, o_custkey AS holder, sum(l_quantity) AS shares, sum(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
  SELECT symbol, holder, shares, round(value, 4) AS value, row_number() OVER (PARTITION BY symbol ORDER BY shares DESC, holder) AS rank FROM h QUALIFY rank <= 10""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    held = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.col("o_custkey").alias("holder")).agg(
        F.sum("l_quantity").alias("shares"), F.sum("l_extendedprice").alias("value"))
    return rounded(sc.top_rows(held, "symbol", [F.col("shares").desc(), F.col("holder")]), 4)


@query("sc_recent_trades", """SELECT event_type AS symbol, event_id, ts, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS shares,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 10""")
def _(spark, sf):
    trades = table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "event_id", "ts",
        F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)"), F.lit(0.0)).alias("shares"))
    return sc.top_rows(trades, "symbol", [F.col("ts").desc(), F.col("event_id").desc()])


SEASON = f"""{BARS}, mo AS (SELECT symbol, date_trunc('month', ts) AS m, arg_max(close, ts) AS close FROM bars GROUP BY ALL),
  ch AS MATERIALIZED (SELECT symbol, year(m) AS year, strftime(m, '%b') AS mon, (close / lag(close) OVER (PARTITION BY symbol ORDER BY m) - 1) * 100 AS c FROM mo)"""


@query("sc_seasonality", f"WITH {SEASON} SELECT symbol, year, {', '.join(f'''round(sum(c) FILTER (mon = '{m}'), 5) AS {m}''' for m in sc.MONTHS)} FROM ch WHERE c IS NOT NULL GROUP BY symbol, year")
def _(spark, sf):
    return rounded(sc.seasonality(bars_from_bars(bars_daily(spark, sf), "month").select("symbol", "ts", "close")), 5)


@query("sc_seasonal_edge", f"""WITH {SEASON}, a AS (SELECT symbol, mon, avg(c) AS c FROM ch WHERE c IS NOT NULL GROUP BY ALL)
  SELECT symbol, arg_max(mon, c) AS best_month, round(max(c), 5) AS best_pct, arg_min(mon, c) AS worst_month, round(min(c), 5) AS worst_pct FROM a GROUP BY symbol""")
def _(spark, sf):
    monthly = bars_from_bars(bars_daily(spark, sf), "month").select("symbol", "ts", "close")
    return rounded(sc.seasonal_edge(sc.seasonality(monthly)), 5)


@query("sc_quotes", f"""WITH {YEARLY}, {PROFILE} SELECT symbol, quote_price AS price, previous_close, round((quote_price - previous_close) / previous_close * 100, 5) AS change_pct,
  CASE WHEN quote_price IS NULL OR previous_close IS NULL THEN 'unavailable' ELSE 'ok' END AS status, CASE WHEN quote_price IS NULL OR previous_close IS NULL THEN 'quote missing price or previous close' END AS detail FROM profile""")
def _(spark, sf):
    return rounded(sc.quotes(profiles(yearly(spark, sf))), 5)


@query("sc_quotes_in_order", f"""WITH {YEARLY}, {PROFILE}, a AS (SELECT s_suppkey AS ordinal, 'S' || (s_suppkey * 7) AS symbol FROM supplier)
  SELECT ordinal, a.symbol, quote_price AS price, round((quote_price - previous_close) / previous_close * 100, 5) AS change_pct, CASE WHEN quote_price IS NULL OR previous_close IS NULL THEN 'unavailable' ELSE 'ok' END AS status,
    CASE WHEN p.symbol IS NULL THEN 'no quote data returned' WHEN quote_price IS NULL OR previous_close IS NULL THEN 'quote missing price or previous close' END AS detail FROM a LEFT JOIN profile p USING (symbol)""")
def _(spark, sf):
    k = F.col("s_suppkey")
    asked = table(spark, sf, "supplier").select(k.alias("ordinal"), F.concat(F.lit("S"), (k * 7).cast("string")).alias("symbol"))
    return rounded(sc.quotes_for(asked, sc.quotes(profiles(yearly(spark, sf)))).drop("previous_close"), 5)


@query("sc_candidate_universe", """SELECT DISTINCT upper(trim(symbol)) AS symbol FROM (SELECT p_brand AS symbol FROM part UNION ALL SELECT event_type FROM events UNION ALL SELECT ' ' || n_name || ' ' FROM nation) WHERE upper(trim(symbol)) NOT IN ('', 'BRAND#7')""")
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("symbol"))
    events = table(spark, sf, "events").select(F.col("event_type").alias("symbol"))
    nations = table(spark, sf, "nation").select(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("symbol"))
    return sc.candidate_universe([parts, events, nations], "Brand#7 ")
