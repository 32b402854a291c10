"""Thresholds of users, and what is scored by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import rounded
from barloom.operators import alerts as al
from barloom.operators import fundamentals as fa
from barloom.operators import risk as rk
from barloom.operators import thresholds as th
from barloom.plans.base_sql import BARS
from barloom.plans.company_sql import BRAND_ANALYZED
from barloom.plans.registry import query
from barloom.plans.replay import RISK_SCORE
from barloom.plans.screen import WIDE_SQL, brand_analyzed, risk_inputs
from barloom.sources.tables import table


def users(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")


def overrides(spark, sf):
    """One override per customer; the key follows the customer number, the value the balance."""
    keys = F.array(*[F.lit(k) for k, *_ in th.EDITABLE])
    return users(spark, sf).select(
        "user_id", F.element_at(keys, (F.col("user_id") % len(th.EDITABLE) + 1).cast("int")).alias("key"), (F.col("c_acctbal") / 100).alias("value"))


_SPEC = "spec AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {d}::DOUBLE, {lo}::DOUBLE, {hi}::DOUBLE)" for i, (k, d, lo, hi) in enumerate(th.EDITABLE)) + ") v(i, key, def, lo, hi))"
EFFECTIVE = f"""{_SPEC}, ef AS MATERIALIZED (SELECT c_custkey AS user_id, key, CASE WHEN i = c_custkey % 17 AND c_acctbal / 100 BETWEEN lo AND hi THEN c_acctbal / 100 ELSE def END AS value,
  i = c_custkey % 17 AND c_acctbal / 100 BETWEEN lo AND hi AS overridden FROM customer, spec)"""


@query("th_effective", f"WITH {EFFECTIVE} SELECT user_id, key, round(value, 6) AS value, overridden FROM ef")
def _(spark, sf):
    return rounded(th.effective(users(spark, sf).select("user_id"), overrides(spark, sf)))


def sector_rows(spark, sf):
    """One sector band per customer, not always a valid one."""
    k = F.col("user_id")
    return users(spark, sf).select(
        "user_id", F.element_at(F.array(*[F.lit(s) for s in ("Energy", "Healthcare", "", "Technology")]), (k % 4 + 1).cast("int")).alias("sector"),
        (k % 11).cast("double").alias("lo"), (k % 23).cast("double").alias("hi"))


def removed_sectors(spark, sf):
    return users(spark, sf).where(F.col("user_id") % 3 == 0).select("user_id", F.lit("Utilities").alias("sector"))


OWN_BANDS = """own AS MATERIALIZED (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'Energy' WHEN 1 THEN 'Healthcare' WHEN 2 THEN '' ELSE 'Technology' END AS sector, (c_custkey % 11)::DOUBLE AS lo, (c_custkey % 23)::DOUBLE AS hi FROM customer)"""
BANDS_OF_USER = f"""{OWN_BANDS}, t AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {lo}::DOUBLE, {hi}::DOUBLE)" for s, (lo, hi) in P.SECTOR_PE.items())}) v(sector, lo, hi)),
  ok AS (SELECT * FROM own WHERE sector <> '' AND lo >= 0 AND hi > lo),
  pe AS MATERIALIZED (SELECT c_custkey AS user_id, sector, lo, hi FROM customer, t WHERE NOT (c_custkey % 3 = 0 AND sector = 'Utilities') AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.user_id = c_custkey AND ok.sector = t.sector) UNION ALL SELECT * FROM ok)"""
WIDE_USER = f"""w AS MATERIALIZED (PIVOT (SELECT user_id, key, value FROM ef) ON key IN ({', '.join(f"'{k}'" for k, *_ in th.EDITABLE)}) USING first(value) GROUP BY user_id)"""


@query("th_problems", f"""WITH {EFFECTIVE}, {WIDE_USER}, {OWN_BANDS}
  SELECT w.user_id, concat_ws('; ', {', '.join(f"CASE WHEN {a} >= {b} THEN '{t}' END" for a, b, t in th.PAIRS)}, CASE WHEN sector <> '' AND hi <= lo THEN 'sector ' || sector || ': P/E band low must be below high' END) AS problems
  FROM w JOIN own USING (user_id)""")
def _(spark, sf):
    wide = th.by_user(th.effective(users(spark, sf).select("user_id"), overrides(spark, sf)))
    return th.problems(wide, sector_rows(spark, sf))


@query("th_sector_pe", f"WITH {BANDS_OF_USER} SELECT user_id, sector, lo, hi FROM pe")
def _(spark, sf):
    return th.sector_pe(users(spark, sf).select("user_id"), removed_sectors(spark, sf), sector_rows(spark, sf))


def classes(spark, sf):
    return th.user_classes(users(spark, sf).select("user_id"), overrides(spark, sf), removed_sectors(spark, sf), sector_rows(spark, sf))


@query("al_default_thresholds", f"""WITH {EFFECTIVE}, {WIDE_USER} SELECT user_id, metric, CASE WHEN metric = 'altman_z' THEN altman_grey_zone ELSE d END AS threshold
  FROM w, (VALUES {', '.join(f"('{k}', {d}::DOUBLE)" for k, *_r, d in al.RISK_METRICS)}) m(metric, d)""")
def _(spark, sf):
    members, by_class = classes(spark, sf)
    metric = F.explode(F.array(*[F.lit(k) for k, *_ in al.RISK_METRICS]))
    wanted = by_class.withColumn("metric", metric)
    wanted = wanted.select("class_id", "metric", al.default_threshold(F.col("metric"), F.col("th_altman_grey_zone")).alias("threshold"))
    return members.join(wanted, "class_id").select("user_id", "metric", "threshold")


_MINE = {"net_margin": "net_margin >= min_net_margin", "debt_to_equity": "debt_to_equity < CASE WHEN an.sector IN ('Financial Services', 'Financials') THEN financials_max_debt_to_equity ELSE max_debt_to_equity END", "roic": "roic_pct > min_roic_pct",
         "interest_coverage": "interest_coverage > min_interest_coverage", "current_ratio": "current_ratio > min_current_ratio", "pe_ratio": "pe_ratio >= coalesce(pe.lo, pe_range_low) AND pe_ratio <= coalesce(pe.hi, pe_range_high)",
         "peg_ratio": "peg_ratio > peg_range_low AND peg_ratio <= peg_range_high", "beta": "beta < max_beta"}
_WT = P.SCORE_WEIGHTS
FOLLOWS = "follows AS MATERIALIZED (SELECT DISTINCT o_custkey AS user_id, p_brand AS symbol FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def follows(spark, sf):
    """Every customer follows the brands it has bought."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("symbol")).distinct()


@query("fa_scorecard_by_user", f"""WITH {BARS}, {BRAND_ANALYZED}, {EFFECTIVE}, {WIDE_USER}, {BANDS_OF_USER}, {FOLLOWS},
  ck AS (SELECT f.user_id, f.symbol, altman_z, altman_safe_zone, altman_grey_zone, high_alignment_pct, moderate_alignment_pct, {', '.join(f'({t}) AS pass_{m}' for m, t in _MINE.items())}, fcf_yield_pct > min_fcf_yield_pct AS pass_fcf
    FROM follows f JOIN an USING (symbol) JOIN w USING (user_id) LEFT JOIN pe ON pe.user_id = f.user_id AND pe.sector = an.sector),
  card AS (SELECT *, {' + '.join(f'coalesce(pass_{m}::INT, 0)' for m in _MINE)} AS g, {' + '.join(f'(pass_{m} IS NOT NULL)::INT' for m in _MINE)} AS n,
    coalesce(({' + '.join(f'coalesce(pass_{m}::INT * {_WT[m]}, 0)' for m in _MINE)})::DOUBLE / nullif({' + '.join(f'(pass_{m} IS NOT NULL)::INT * {_WT[m]}' for m in _MINE)}, 0)::DOUBLE * 100, 0) AS s FROM ck)
  SELECT user_id, symbol, g::BIGINT AS green_flags, n::BIGINT AS total_checks, round(s, 4) AS score_pct, CASE WHEN s >= high_alignment_pct THEN 'high' WHEN s >= moderate_alignment_pct THEN 'moderate' ELSE 'low' END AS alignment,
    CASE WHEN pass_fcf THEN 'pass' WHEN NOT pass_fcf THEN 'fail' ELSE 'n/a' END AS fcf_yield, CASE WHEN altman_z > altman_safe_zone THEN 'safe' WHEN altman_z >= altman_grey_zone THEN 'grey' WHEN altman_z IS NOT NULL THEN 'distress' ELSE 'insufficient data' END AS altman_zone FROM card""")
def _(spark, sf):
    members, by_class = classes(spark, sf)
    out = fa.scorecard_by_user(brand_analyzed(spark, sf), follows(spark, sf), members, by_class)
    fcf = F.when(F.col("pass_fcf_yield"), "pass").when(~F.col("pass_fcf_yield"), "fail").otherwise("n/a")
    return rounded(out.select("user_id", "symbol", "green_flags", "total_checks", "score_pct", "alignment", fcf.alias("fcf_yield"), "altman_zone"), 4)


_BY_ZONE = RISK_SCORE.replace("2.99", "altman_safe_zone")


@query("risk_score_by_user", f"""WITH {WIDE_SQL}, {EFFECTIVE}, {WIDE_USER}, {FOLLOWS}, j AS (SELECT f.user_id, wide.*, altman_safe_zone FROM follows f JOIN wide USING (symbol) JOIN w USING (user_id))
  SELECT user_id, symbol, {_BY_ZONE} AS risk_score, CASE WHEN {_BY_ZONE} >= 75 THEN 'low risk' WHEN {_BY_ZONE} >= 50 THEN 'moderate risk' WHEN {_BY_ZONE} >= 30 THEN 'elevated risk' ELSE 'high risk' END AS risk_grade FROM j""")
def _(spark, sf):
    members, by_class = classes(spark, sf)
    out = th.for_followers(risk_inputs(spark, sf), follows(spark, sf), members, by_class, lambda rows: rk.risk_score(rows, th.of_class()["altman_safe_zone"]))
    return out.select("user_id", "symbol", "risk_score", "risk_grade")
