"""Point-in-time and projection queries."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from barloom.functions.series import rounded
from barloom.operators import project as pj
from barloom.operators import replay as hc
from barloom.operators import fundamentals as fa
from barloom.plans.base_sql import BARS, FROM_TICKS, RETS, RETURNS, RSI_CTE, TICKS, full
from barloom.plans.company_sql import AN, BRAND_ANALYZED, GATE, PROFILE, ST, STD_PRICED, YEARLY, YEARLY_BRAND, LAST_CLOSE, intrinsic
from barloom.plans.fundamentals import GROWTH, SCORE, company_tables
from barloom.plans.registry import query
from barloom.plans.risk import METRICS, PERF, closes, drawdown_sql, staged_closes, tail_sql
from barloom.plans.screen import brand_analyzed
from barloom.sources.companies import profiles, statements, yearly

AS_OF, NOW = "1998-09-30", "2001-12-31"
DATES = ("1995-01-15", "1997-03-31", AS_OF)
_DATES_SQL = "(VALUES " + ", ".join(f"(DATE '{d}')" for d in DATES) + ") d(as_of)"


@query("hc_available_range", f"WITH {BARS} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY symbol")
def _(spark, sf):
    return hc.available_range(closes(spark, sf))


@query("hc_statement_period", f"""WITH {YEARLY}, p AS (SELECT DISTINCT symbol, make_date(yr, 12, 31) AS pe FROM yr)
  SELECT s.symbol, as_of::TIMESTAMP AS as_of, max(pe)::TIMESTAMP AS statement_period FROM (SELECT DISTINCT symbol FROM p) s CROSS JOIN {_DATES_SQL} LEFT JOIN p ON p.symbol = s.symbol AND pe <= as_of GROUP BY ALL""")
def _(spark, sf):
    out = hc.statement_period_for(statements(yearly(spark, sf)), DATES)
    return out.select("symbol", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("as_of", "statement_period")])


@query("hc_warnings", f"""WITH {BARS}, {YEARLY_BRAND}, p AS (SELECT DISTINCT symbol, make_date(yr, 12, 31) AS pe FROM yr),
  b AS (SELECT symbol, as_of, count(*) AS n FROM bars, {_DATES_SQL} WHERE ts::DATE <= as_of GROUP BY ALL),
  f AS (SELECT s.symbol, as_of, max(pe) AS sp FROM (SELECT DISTINCT symbol FROM p) s CROSS JOIN {_DATES_SQL} LEFT JOIN p ON p.symbol = s.symbol AND pe <= as_of GROUP BY ALL)
  SELECT symbol, as_of::TIMESTAMP AS as_of, coalesce(n, 0) AS bars, concat_ws('; ', CASE WHEN coalesce(n, 0) < 30 THEN 'only ' || coalesce(n, 0) || ' bars' END, CASE WHEN sp IS NULL THEN 'no statement filed yet' END) AS warnings FROM f LEFT JOIN b USING (symbol, as_of)""")
def _(spark, sf):
    counts = hc.bars_as_of(closes(spark, sf), DATES).groupBy("symbol", "as_of").agg(F.count(F.lit(1)).alias("bars"))
    out = hc.warnings(counts, hc.statement_period_for(statements(yearly(spark, sf, "brand")), DATES))
    return out.select("symbol", F.col("as_of").cast("timestamp_ntz").alias("as_of"), F.coalesce("bars", F.lit(0)).cast("long").alias("bars"), "warnings")


def _then(text: str) -> str:
    """The same CTEs under names ending in _q."""
    names = "ticks bars rets chg wl rsi perf rec cut tail mdd_d mdd_t mdd_r mdd vol metrics st profile lc nw hi s0 std tx an ck card".split()
    return re.sub(r"\b(" + "|".join(names) + r")\b", r"\1_q", text)


TAIL_CTES = f"{RETS}, {RSI_CTE}, {METRICS}"
THEN = f"""ticks_q AS (SELECT * FROM ticks WHERE ts::DATE <= DATE '{AS_OF}'), {_then(FROM_TICKS + ', ' + TAIL_CTES)},
  st_q AS (SELECT * FROM st WHERE period_end <= DATE '{AS_OF}'), {_then(LAST_CLOSE)},
  sh_q AS (SELECT symbol, coalesce(arg_max(osn, period_end) FILTER (osn IS NOT NULL), arg_max(iss, period_end) FILTER (iss IS NOT NULL)) AS shares_then FROM st_q GROUP BY symbol),
  n1_q AS (SELECT * FROM st_q QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) = 1),
  profile_q AS (SELECT n.symbol, n.k, sector, NULL::DOUBLE AS trailing_pe, NULL::DOUBLE AS price_to_book, ni / nullif(revenue, 0) AS profit_margins, NULL::DOUBLE AS return_on_equity, NULL::DOUBLE AS debt_to_equity,
    ca / nullif(cl, 0) AS current_ratio, NULL::DOUBLE AS beta, NULL::DOUBLE AS earnings_growth, NULL::DOUBLE AS revenue_growth, shares_then * last_close AS market_cap, NULL::DOUBLE AS shares_outstanding,
    NULL::DOUBLE AS quote_price, NULL::DOUBLE AS total_debt_reported, NULL::DOUBLE AS interest_reported, NULL::DOUBLE AS held_pct_insiders, NULL::DOUBLE AS held_pct_institutions, NULL::DATE AS most_recent_quarter
    FROM n1_q n LEFT JOIN profile p USING (symbol) LEFT JOIN sh_q USING (symbol) LEFT JOIN lc_q USING (symbol)), {_then(STD_PRICED + ', ' + AN + ', ' + SCORE)}"""


def _side(s: str) -> str:
    pe = "pe_computed" if s else "pe_ratio"
    score = RISK_SCORE
    return f"""w{s}_ AS (SELECT c.*, {pe} AS pe_shown, m.last_close AS close, m.ann_vol, m.rolling_vol, m.hist_var, m.expected_shortfall, m.max_drawdown, m.sharpe, m.sortino, m.calmar, r.rsi, s.sma_50, s.sma_200
    FROM metrics{s} m LEFT JOIN card{s} c USING (symbol) LEFT JOIN (SELECT symbol, arg_max(rsi{s}, ts) AS rsi FROM rsi{s} WHERE rsi{s} IS NOT NULL GROUP BY symbol) r USING (symbol)
    LEFT JOIN (SELECT symbol, arg_max(a, ts) FILTER (a IS NOT NULL) AS sma_50, arg_max(b, ts) FILTER (b IS NOT NULL) AS sma_200 FROM (SELECT symbol, ts, {full('avg', 'close', 50)} AS a, {full('avg', 'close', 200)} AS b FROM bars{s}) GROUP BY symbol) s USING (symbol)),
  v{s}_ AS (SELECT *, {score} AS risk_score FROM w{s}_),
  l{s}_ AS ({' UNION ALL '.join(f"SELECT symbol, '{g}' AS grp, '{m}' AS metric, ({'pe_shown' if e == 'pe_ratio' else e})::DOUBLE AS v FROM v{s}_" for g, m, e in hc.ROWS)})"""


def _anch(n, best, worst):
    return f"greatest(0, least(1, ({n} - ({worst})) / (({best}) - ({worst}))))::DOUBLE * 100"


def _risk_score_sql() -> str:
    from barloom import params as P

    num = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {_anch(n, b, w)} * {wt}::DOUBLE END" for n, b, w, wt in P.RISK_FACTORS)
    den = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {wt} END" for n, b, w, wt in P.RISK_FACTORS)
    return f"round(coalesce(({num}) / nullif(({den})::DOUBLE, 0), 0), 1)"


RISK_SCORE = _risk_score_sql()


@query("hc_comparison", f"""WITH {TICKS}, {FROM_TICKS}, {TAIL_CTES}, {BRAND_ANALYZED}, {SCORE}, {THEN}, {_side('')}, {_side('_q')}
  SELECT symbol, TIMESTAMP '{AS_OF}' AS as_of, grp, metric, round(t.v, 3) AS "then", round(n.v, 3) AS now, round(n.v - t.v, 3) AS delta FROM l_q_ t FULL JOIN l_ n USING (symbol, grp, metric)""")
def _(spark, sf):
    periods, profile = company_tables(spark, sf, "brand")
    out = hc.comparison(staged_closes(spark, sf), periods, profile, [AS_OF], NOW)
    return rounded(out.withColumn("as_of", F.col("as_of").cast("timestamp_ntz")), 3)


U = "(('0x' || substr(md5({0}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
STATS = """SELECT symbol, count(*) AS sims, round(avg(CASE WHEN e > start THEN 1 ELSE 0 END) * 100, 5) AS pct_above, round(quantile_cont(e, 0.1), 5) AS p10, round(quantile_cont(e, 0.5), 5) AS p50, round(quantile_cont(e, 0.9), 5) AS p90,
  CASE WHEN avg(CASE WHEN e > start THEN 1 ELSE 0 END) * 100 >= 65 THEN 'upside' WHEN avg(CASE WHEN e > start THEN 1 ELSE 0 END) * 100 <= 40 THEN 'downside' ELSE 'balanced' END AS bias FROM ends GROUP BY symbol"""


@query("mc_gbm", f"""WITH {BARS}, r AS (SELECT symbol, ts, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars),
  s AS (SELECT symbol, arg_max(close, ts) AS start, avg(r) AS m, stddev_samp(r) AS sd FROM r GROUP BY symbol HAVING count(r) > 30),
  x AS (SELECT symbol, sim, start, m - 0.5 * sd * sd + sd * sqrt(-2 * ln({U.format("symbol || '|' || sim || '|' || day || '|a'")})) * cos(2 * {math.pi!r}::DOUBLE * {U.format("symbol || '|' || sim || '|' || day || '|b'")}) AS step
    FROM s, range(1000) a(sim), range(1, 61) b(day)), ends AS (SELECT symbol, sim, any_value(start) AS start, any_value(start) * exp(sum(step)) AS e FROM x GROUP BY ALL) {STATS}""")
def _(spark, sf):
    return rounded(pj.terminal_stats(pj.gbm_steps(staged_closes(spark, sf))).drop("seed"), 5)


@query("mc_bootstrap", f"""WITH {RETURNS}, ix AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM rets WHERE ret IS NOT NULL),
  s AS (SELECT symbol, arg_max(close, ts) AS start, count(ret) AS n FROM rets GROUP BY symbol HAVING count(ret) > 30),
  x AS (SELECT symbol, sim, start, (floor({U.format("symbol || '|' || sim || '|' || ((day - 1) // 5)")} * (n - 4)) + (day - 1) % 5)::BIGINT AS i FROM s, range(1000) a(sim), range(1, 61) b(day)),
  ends AS (SELECT x.symbol, sim, any_value(start) AS start, any_value(start) * exp(sum(ret)) AS e FROM x JOIN ix ON x.symbol = ix.symbol AND x.i = ix.i GROUP BY ALL) {STATS}""")
def _(spark, sf):
    return rounded(pj.terminal_stats(pj.bootstrap_steps(staged_closes(spark, sf))).drop("seed"), 5)


@query("mc_paths", f"""WITH {RETURNS}, ix AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM rets WHERE ret IS NOT NULL),
  s AS (SELECT symbol, arg_max(close, ts) AS start, count(ret) AS n FROM rets GROUP BY symbol HAVING count(ret) > 30),
  x AS (SELECT symbol, sim, day, start, (floor({U.format("symbol || '|' || sim || '|' || ((day - 1) // 5)")} * (n - 4)) + (day - 1) % 5)::BIGINT AS i FROM s, range(1000) a(sim), range(1, 61) b(day))
  SELECT x.symbol, sim, day, round(start * exp(sum(ret) OVER (PARTITION BY x.symbol, sim ORDER BY day)), 5) AS price FROM x JOIN ix ON x.symbol = ix.symbol AND x.i = ix.i""")
def _(spark, sf):
    return rounded(pj.paths(pj.bootstrap_steps(staged_closes(spark, sf))), 5)


SCN = "scn AS (SELECT * FROM (VALUES " + ", ".join(f"('{s.name}', {s.growth_delta}::DOUBLE, {s.discount_delta}::DOUBLE, {s.vol_mult}::DOUBLE, {s.mean_shift}::DOUBLE)" for s in pj.PRESETS) + ") v(scenario, gd, dd, vm, ms))"
DCFS = f"""ds AS (SELECT an.*, scenario, coalesce({GATE}, CASE WHEN wacc + dd <= 0.02 THEN 'shocked discount rate at or below terminal growth' END) AS reason, 0.15::DOUBLE + gd AS g1, wacc + dd AS r1 FROM an, scn),
  dcfs AS MATERIALIZED (SELECT symbol, scenario, reason, CASE WHEN reason IS NULL THEN {intrinsic('0.15::DOUBLE', 'wacc')} END AS base_intrinsic, CASE WHEN reason IS NULL THEN {intrinsic('g1', 'r1')} END AS shocked_intrinsic FROM ds)"""
SHOCK = """shocked AS MATERIALIZED (SELECT symbol, scenario, symbol || '/' || scenario AS sk, ts, first_value(close) OVER w * exp(sum(coalesce(ret * vm + ms, 0)) OVER w) AS close FROM rets, scn WINDOW w AS (PARTITION BY symbol, scenario ORDER BY ts))"""


@query("sm_shocked_prices", f"WITH {RETURNS}, {SCN}, {SHOCK} SELECT symbol, scenario, ts, round(close, 5) AS close FROM shocked")
def _(spark, sf):
    return rounded(pj.shocked_prices(closes(spark, sf)), 5)


AFTER = f"""sr AS (SELECT sk AS symbol, ts, ln(close / lag(close) OVER (PARTITION BY sk ORDER BY ts)) AS ret FROM shocked), sb AS (SELECT sk AS symbol, ts, close FROM shocked),
  {re.sub(r'rets', 'sr', PERF).replace('perf AS', 'perf2 AS')}, {re.sub(r'(rec|cut|tail)', r'\1_2', tail_sql(0.95, 252)).replace('rets', 'sr')}, {drawdown_sql('sb', name='mdd2')}"""


@query("sm_run_scenarios", f"""WITH {RETURNS}, {METRICS}, {BRAND_ANALYZED}, {SCN}, {DCFS}, {SHOCK}, {AFTER},
  dv AS (SELECT symbol, dividend_rate * 0.5::DOUBLE AS lost_income, dividend_rate * 0.5::DOUBLE / quote_price * 100 AS shocked_yield_pct FROM profile WHERE dividend_rate > 0 AND quote_price > 0)
  SELECT d.symbol, d.scenario, reason, round(base_intrinsic, 3) AS base_intrinsic, round(shocked_intrinsic, 3) AS shocked_intrinsic, round((shocked_intrinsic - base_intrinsic) / nullif(base_intrinsic, 0) * 100, 4) AS change_pct,
    round(p.sharpe, 5) AS shocked_sharpe, round(t.hist_var_, 6) AS shocked_hist_var, round(t.expected_shortfall, 6) AS shocked_expected_shortfall, round(x.max_drawdown, 6) AS shocked_max_drawdown,
    round(m.sharpe, 5) AS base_sharpe, round(m.hist_var, 6) AS base_hist_var, round(m.expected_shortfall, 6) AS base_expected_shortfall, round(m.max_drawdown, 6) AS base_max_drawdown,
    round(CASE WHEN d.scenario = 'Dividend Cut' THEN lost_income END, 5) AS lost_income, round(CASE WHEN d.scenario = 'Dividend Cut' THEN shocked_yield_pct END, 5) AS shocked_yield_pct,
    round(10000 * ((shocked_intrinsic - base_intrinsic) / nullif(base_intrinsic, 0) * 100) / 100, 3) AS implied_change
  FROM dcfs d LEFT JOIN perf2 p ON p.symbol = d.symbol || '/' || d.scenario LEFT JOIN (SELECT symbol, hist_var AS hist_var_, expected_shortfall FROM tail_2) t ON t.symbol = d.symbol || '/' || d.scenario
    LEFT JOIN mdd2 x ON x.symbol = d.symbol || '/' || d.scenario LEFT JOIN metrics m ON m.symbol = d.symbol LEFT JOIN dv ON dv.symbol = d.symbol""")
def _(spark, sf):
    daily = staged_closes(spark, sf)
    _p, profile = company_tables(spark, sf, "brand")
    out = pj.run_scenarios(brand_analyzed(spark, sf, daily), profile, daily, GROWTH)
    return rounded(out, 6, base_intrinsic=3, shocked_intrinsic=3, change_pct=4, base_sharpe=5, shocked_sharpe=5, lost_income=5, shocked_yield_pct=5, implied_change=3)


@query("sm_dividend_cut", f"""WITH {YEARLY}, {PROFILE} SELECT symbol, coalesce(dividend_rate > 0 AND quote_price > 0, false) AS applicable,
  CASE WHEN coalesce(dividend_rate, 0) <= 0 THEN 'no regular dividend' WHEN coalesce(quote_price, 0) <= 0 THEN 'price unavailable' END AS detail,
  round(CASE WHEN dividend_rate > 0 AND quote_price > 0 THEN dividend_rate * 0.5::DOUBLE END, 6) AS shocked_dividend, round(CASE WHEN dividend_rate > 0 AND quote_price > 0 THEN dividend_rate * 0.5::DOUBLE END, 6) AS lost_income,
  round(CASE WHEN dividend_rate > 0 AND quote_price > 0 THEN dividend_rate / quote_price * 100 END, 6) AS yield_pct, round(CASE WHEN dividend_rate > 0 AND quote_price > 0 THEN dividend_rate * 0.5::DOUBLE / quote_price * 100 END, 6) AS shocked_yield_pct FROM profile""")
def _(spark, sf):
    return rounded(pj.dividend_cut(profiles(yearly(spark, sf)), 50.0))
