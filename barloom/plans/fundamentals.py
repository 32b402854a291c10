"""Fundamental queries over supplier companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import rounded
from barloom.operators import fundamentals as fa
from barloom.plans.company_sql import ANALYZED, COMPANY, GATE, PROFILE, ST, YEARLY, intrinsic
from barloom.plans.registry import query
from barloom.sources.companies import profiles, statements, yearly
from barloom.session import stage
from barloom.sources.tables import table

AS_OF = "2001-12-31"
GROWTH = 0.15


def company_tables(spark, sf, by="supplier"):
    years = stage(yearly(spark, sf, by))
    return fa.by_period(statements(years)), profiles(years)


def standardized(spark, sf):
    periods, profile = company_tables(spark, sf)
    return fa.standardize(periods, profile)


def analyzed(spark, sf):
    return fa.ratios(standardized(spark, sf))


def cols(names, digits):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


#: Column of the SQL statement table -> (statement, item).
STATEMENT_ITEMS = {
    "revenue": ("income", "Total Revenue"), "ebit_line": ("income", "EBIT"), "oi": ("income", "Operating Income"), "ni": ("income", "Net Income"),
    "ie": ("income", "Interest Expense"), "gp": ("income", "Gross Profit"), "pretax": ("income", "Pretax Income"), "tax": ("income", "Tax Provision"),
    "ta": ("balance", "Total Assets"), "ca": ("balance", "Current Assets"), "cl": ("balance", "Current Liabilities"), "eq": ("balance", "Stockholders Equity"),
    "tl": ("balance", "Total Liabilities Net Minority Interest"), "ncl": ("balance", "Total Non Current Liabilities Net Minority Interest"),
    "debt": ("balance", "Total Debt"), "re": ("balance", "Retained Earnings"), "inv": ("balance", "Inventory"), "cash1": ("balance", "Cash And Cash Equivalents"),
    "cash2": ("balance", "Cash Cash Equivalents And Short Term Investments"), "osn": ("balance", "Ordinary Shares Number"), "iss": ("balance", "Share Issued"),
    "fcf": ("cash", "Free Cash Flow"), "da1": ("cash", "Depreciation And Amortization"), "da2": ("cash", "Depreciation Amortization Depletion"),
    "capex": ("cash", "Capital Expenditure"), "nwc": ("cash", "Change In Working Capital")}


@query("fa_statements", f"""WITH {YEARLY}, {ST}, u AS (UNPIVOT (SELECT symbol, period_end, {", ".join(f"{c}::DOUBLE AS {c}" for c in STATEMENT_ITEMS)} FROM st) ON {", ".join(STATEMENT_ITEMS)} INTO NAME col VALUE value)
  SELECT symbol, statement, item, period_end::TIMESTAMP AS period, round(value, 8) AS value
  FROM u JOIN (VALUES {", ".join(f"('{c}', '{s}', '{i}')" for c, (s, i) in STATEMENT_ITEMS.items())}) m(col, statement, item) USING (col)""")
def _(spark, sf):
    out = statements(yearly(spark, sf))
    return rounded(out.select("symbol", "statement", "item", F.col("period_end").cast("timestamp_ntz").alias("period"), "value"), 8)


@query("fa_field_history", f"""WITH {YEARLY}, {ST} SELECT symbol, count(coalesce(CASE WHEN c > 0 THEN ebit_line ELSE oi END)) AS periods,
  string_agg(strftime(period_end, '%Y-%m-%d'), ' ' ORDER BY period_end) FILTER (CASE WHEN c > 0 THEN ebit_line ELSE oi END IS NOT NULL) AS dates,
  round(sum(CASE WHEN c > 0 THEN ebit_line ELSE oi END), 2) AS total FROM (SELECT *, count(ebit_line) OVER (PARTITION BY symbol) AS c FROM st) GROUP BY symbol""")
def _(spark, sf):
    periods, _p = company_tables(spark, sf)
    h = fa.field_history(periods, ("EBIT", "Operating Income"))
    return rounded(h.select(
        "symbol", F.size("history").cast("long").alias("periods"),
        F.array_join(F.transform("history", lambda x: x["period_end"].cast("string")), " ").alias("dates"),
        F.aggregate("history", F.lit(0.0), lambda a, x: a + x["value"]).alias("total")), 2)


FIELD_SQL = {"Total Assets": "ta", "Current Assets": "ca", "Current Liabilities": "cl", "Stockholders Equity": "eq", "Total Liabilities": "tl", "Total Debt": "debt", "Retained Earnings": "re",
             "Inventory": "inv", "Cash": "coalesce(cash1, cash2)", "Total Revenue": "revenue", "EBIT": "coalesce(ebit_line, oi)", "Net Income": "ni", "Interest Expense": "ie", "Gross Profit": "gp",
             "Operating Income": "oi", "Pretax Income": "pretax", "Tax Provision": "tax", "Free Cash Flow": "fcf", "Depreciation And Amortization": "coalesce(da1, da2)"}
VALID = f"""{YEARLY}, {ST}, nw AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) = 1), checks AS MATERIALIZED (
  {' UNION ALL '.join(f"SELECT symbol, '{s}' AS statement, '{n}' AS field, {str(r).lower()} AS required, {FIELD_SQL[n]} IS NOT NULL AS present FROM nw" for s, n, _, r in fa.FIELDS)})"""


@query("fa_validation", f"WITH {VALID} SELECT * FROM checks")
def _(spark, sf):
    return fa.validation(company_tables(spark, sf)[0])


@query("fa_statement_validity", f"""WITH {VALID} SELECT symbol, statement, coalesce(string_agg(field, ', ' ORDER BY field) FILTER (required AND NOT present), '') AS missing_required,
  coalesce(string_agg(field, ', ' ORDER BY field) FILTER (NOT required AND NOT present), '') AS missing_optional, bool_and(present OR NOT required) AS is_valid FROM checks GROUP BY ALL""")
def _(spark, sf):
    return fa.statement_validity(fa.validation(company_tables(spark, sf)[0]))


def load_status(spark, sf):
    """Fetch problems per supplier: no line items at all is an error, no filing date a warning."""
    names = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), (F.col("s_acctbal") < 0).alias("neg"))
    prof = profiles(yearly(spark, sf)).select("symbol", "most_recent_quarter", F.lit(True).alias("found"))
    out = names.join(prof, "symbol", "left")
    return out.select("symbol", "most_recent_quarter", F.col("found").isNull().cast("long").alias("errors"),
                      (F.col("neg").cast("long") + F.col("most_recent_quarter").isNull().cast("long")).alias("warnings"))


@query("fa_data_quality", f"""WITH {VALID}, {PROFILE}, c AS (SELECT symbol, count(*) FILTER (required AND present) / count(*) FILTER (required)::DOUBLE * 100 AS rp,
    count(*) FILTER (NOT required AND present) / count(*) FILTER (NOT required)::DOUBLE * 100 AS op FROM checks GROUP BY symbol),
  l AS (SELECT 'S' || s_suppkey AS symbol, most_recent_quarter AS q, (p.symbol IS NULL)::INT AS e, (s_acctbal < 0)::INT + (most_recent_quarter IS NULL)::INT AS w FROM supplier LEFT JOIN profile p ON p.symbol = 'S' || s_suppkey),
  x AS (SELECT symbol, coalesce(rp, 0) AS rp, coalesce(op, 0) AS op, date_diff('day', q, DATE '{AS_OF}') AS d, greatest(0, 100 - e * 30 - w * 10) AS rel FROM l LEFT JOIN c USING (symbol)),
  y AS (SELECT *, CASE WHEN d IS NULL THEN 70 WHEN d <= 120 THEN 100 ELSE greatest(0, 100 - (d - 120) / 245::DOUBLE * 100) END AS fr FROM x),
  z AS (SELECT *, 0.6::DOUBLE * rp + 0.15::DOUBLE * op + 0.15::DOUBLE * fr + 0.1::DOUBLE * rel AS s FROM y)
  SELECT symbol, round(s, 1) AS score, CASE WHEN s >= 90 THEN 'Excellent' WHEN s >= 75 THEN 'Good' WHEN s >= 55 THEN 'Fair' ELSE 'Poor' END AS grade, round(rp, 1) AS required_pct, round(op, 1) AS optional_pct,
    round(fr, 1) AS freshness, round(rel, 1)::DOUBLE AS reliability, d AS staleness_days, coalesce(d > 120, false) AS is_stale FROM z""")
def _(spark, sf):
    checks = fa.validation(company_tables(spark, sf)[0])
    return fa.data_quality(checks, load_status(spark, sf), F.lit(AS_OF).cast("date"))


STD_COLS = ["pe_ratio", "peg_ratio", "price_to_book", "net_margin", "debt_to_equity", "current_ratio", "beta", "earnings_growth", "market_cap", "shares", "price",
            "total_assets", "equity", "total_liabilities", "total_debt", "inventory", "cash", "revenue", "ebit", "interest", "free_cash_flow", "depreciation"]


@query("fa_standardized", f"WITH {COMPANY} SELECT symbol, sector, fallbacks, {cols(STD_COLS, 4)} FROM std")
def _(spark, sf):
    return rounded(standardized(spark, sf).select("symbol", "sector", "fallbacks", *STD_COLS), 4)


AN_COLS = ["tax_rate", "gross_margin_pct", "operating_margin_pct", "roa_pct", "net_margin_pct", "roe_pct", "current_ratio_computed", "quick_ratio_computed", "interest_coverage", "fcf_yield_pct",
           "pe_computed", "pb_computed", "ev_ebitda", "asset_turnover", "roic_pct", "wacc", "beta_used", "normal_margin", "da_ratio", "capex_ratio", "nwc_ratio"]


@query("fa_ratios", f"WITH {ANALYZED} SELECT symbol, tax_fallback, beta_source, {cols(AN_COLS, 6)} FROM an")
def _(spark, sf):
    return rounded(analyzed(spark, sf).select("symbol", "tax_fallback", "beta_source", *AN_COLS))


@query("fa_altman", f"""WITH {ANALYZED} SELECT symbol, round(altman_z, 6) AS altman_z, CASE WHEN altman_z > 2.99 THEN 'safe' WHEN altman_z >= 1.81 THEN 'grey' WHEN altman_z IS NOT NULL THEN 'distress' ELSE 'insufficient data' END AS altman_zone,
  altman_missing FROM an""")
def _(spark, sf):
    return rounded(analyzed(spark, sf).select("symbol", "altman_z", "altman_zone", "altman_missing"))


DCF = f"""dg AS (SELECT *, {GATE} AS dcf_reason FROM an), dv AS (SELECT *, CASE WHEN dcf_reason IS NULL THEN {intrinsic('0.15::DOUBLE', 'wacc')} END AS intrinsic FROM dg),
  dcf AS MATERIALIZED (SELECT *, (intrinsic - price) / nullif(intrinsic, 0) * 100 AS safety_pct FROM dv)"""
DCF_STATUS = "CASE WHEN safety_pct >= 20 THEN 'Strong Buy' WHEN safety_pct > 0 THEN 'Buy' WHEN safety_pct IS NOT NULL THEN 'Overvalued' END"


@query("fa_dcf", f"WITH {ANALYZED}, {DCF} SELECT symbol, dcf_reason, round(wacc, 6) AS wacc, round(intrinsic, 4) AS intrinsic, round(safety_pct, 4) AS safety_pct, {DCF_STATUS} AS dcf_status FROM dcf")
def _(spark, sf):
    return rounded(fa.dcf(analyzed(spark, sf), GROWTH).select("symbol", "dcf_reason", "wacc", "intrinsic", "safety_pct", "dcf_status"), 4, wacc=6)


@query("fa_dcf_grid", f"""WITH {ANALYZED}, g AS (SELECT an.*, greatest(0.01::DOUBLE, wacc - 0.02::DOUBLE) + (wacc + 0.02::DOUBLE - greatest(0.01::DOUBLE, wacc - 0.02::DOUBLE)) * (i / 2::DOUBLE) AS discount,
    greatest(0.01::DOUBLE, 0.15::DOUBLE - 0.05::DOUBLE) + (0.15::DOUBLE + 0.05::DOUBLE - greatest(0.01::DOUBLE, 0.15::DOUBLE - 0.05::DOUBLE)) * (j / 2::DOUBLE) AS growth
    FROM an, range(3) a(i), range(3) b(j) WHERE {GATE} IS NULL)
  SELECT symbol, round(discount, 6) AS discount, round(growth, 6) AS growth, round({intrinsic('growth', 'discount')}, 3) AS intrinsic FROM g""")
def _(spark, sf):
    return rounded(fa.dcf_grid(analyzed(spark, sf), GROWTH), 6, intrinsic=3)


_REF = {"profit_margins * 100": "p.profit_margins * 100", "gross_margins * 100": "p.gross_margins * 100", "operating_margins * 100": "p.operating_margins * 100", "return_on_assets * 100": "p.return_on_assets * 100",
        "reported_roe * 100": "p.return_on_equity * 100", "reported_current_ratio": "p.current_ratio", "quick_ratio": "p.quick_ratio",
        "reported_de": "CASE WHEN abs(p.debt_to_equity) >= 5 THEN p.debt_to_equity / 100 ELSE p.debt_to_equity END", "total_debt_reported / 1e9": "p.total_debt_reported / 1e9", "pe_ratio": "a.pe_ratio",
        "price_to_book": "a.price_to_book", "reported_peg": "p.peg_ratio", "enterprise_to_ebitda": "p.enterprise_to_ebitda", None: "NULL"}
_OUT = "CASE metric " + " ".join(f"WHEN '{m}' THEN {'abs(computed)' if s else 'computed'} > {lim}" for m, lim, s in P.OUTLIER_BOUNDS) + " END"
REPORT = f"""rp AS ({' UNION ALL '.join(f"SELECT a.symbol, '{c}' AS category, '{m}' AS metric, (a.{x})::DOUBLE AS computed, ({_REF[y]})::DOUBLE AS reported FROM an a JOIN profile p USING (symbol)" for c, m, x, y in fa.REPORT)}),
  report AS MATERIALIZED (SELECT *, abs(computed - reported) / greatest(abs(reported), 1e-9) <= 0.15 AS agrees, coalesce({_OUT}, false) AS outlier FROM rp)"""


@query("fa_validation_report", f"""WITH {ANALYZED}, {REPORT} SELECT symbol, category, metric, round(computed, 5) AS computed, round(reported, 5) AS reported,
  CASE WHEN agrees THEN 'yes' WHEN NOT agrees THEN 'no' ELSE 'not evaluable' END AS agreement, outlier FROM report""")
def _(spark, sf):
    periods, profile = company_tables(spark, sf)
    out = fa.validation_report(fa.ratios(fa.standardize(periods, profile)), profile)
    text = F.when(F.col("agrees"), "yes").when(~F.col("agrees"), "no").otherwise("not evaluable")
    return rounded(out.withColumn("agreement", text).drop("agrees"), 5)


@query("fa_validation_summary", f"""WITH {ANALYZED}, {REPORT}, c AS (SELECT symbol, count(computed) AS evaluated, count(*) FILTER (NOT agrees) AS disagreements, count(*) FILTER (outlier) AS outliers FROM report GROUP BY symbol),
  n AS (SELECT symbol, CASE WHEN fallbacks = '' THEN 0 ELSE len(string_split(fallbacks, ', ')) END + tax_fallback::INT AS fallbacks FROM an)
  SELECT symbol, evaluated, disagreements, outliers, fallbacks::BIGINT AS fallbacks, (disagreements + outliers + fallbacks)::BIGINT AS issues, disagreements + outliers + fallbacks = 0 AS is_clean FROM c JOIN n USING (symbol)""")
def _(spark, sf):
    periods, profile = company_tables(spark, sf)
    done = fa.ratios(fa.standardize(periods, profile))
    return fa.validation_summary(fa.validation_report(done, profile), done)


LO = "CASE sector " + " ".join(f"WHEN '{s}' THEN {lo}" for s, (lo, _) in P.SECTOR_PE.items()) + " ELSE 10 END"
HI = "CASE sector " + " ".join(f"WHEN '{s}' THEN {hi}" for s, (_, hi) in P.SECTOR_PE.items()) + " ELSE 45 END"
DE = "CASE WHEN sector IN ('Financial Services', 'Financials') THEN 4.0 ELSE 2.5 END"
_PASS = {"net_margin": "net_margin >= 0.10", "debt_to_equity": f"debt_to_equity < {DE}", "roic": "roic_pct > 10", "interest_coverage": "interest_coverage > 3", "current_ratio": "current_ratio > 1",
         "pe_ratio": f"pe_ratio >= {LO} AND pe_ratio <= {HI}", "peg_ratio": "peg_ratio > 0 AND peg_ratio <= 2.5", "beta": "beta < 1.5"}
_W = P.SCORE_WEIGHTS
SCORE = f"""ck AS (SELECT *, {', '.join(f'({t}) AS pass_{m}' for m, t in _PASS.items())}, fcf_yield_pct > 4 AS pass_fcf_yield FROM an),
  card AS MATERIALIZED (SELECT *, {' + '.join(f'coalesce(pass_{m}::INT, 0)' for m in _PASS)} AS green_flags, {' + '.join(f'(pass_{m} IS NOT NULL)::INT' for m in _PASS)} AS total_checks,
    coalesce(({' + '.join(f'coalesce(pass_{m}::INT * {_W[m]}, 0)' for m in _PASS)})::DOUBLE / nullif({' + '.join(f'(pass_{m} IS NOT NULL)::INT * {_W[m]}' for m in _PASS)}, 0)::DOUBLE * 100, 0) AS score_pct FROM ck)"""


@query("fa_scorecard", f"""WITH {ANALYZED}, {SCORE} SELECT symbol, green_flags::BIGINT AS green_flags, total_checks::BIGINT AS total_checks, round(score_pct, 4) AS score_pct,
  CASE WHEN score_pct >= 75 THEN 'high' WHEN score_pct >= 40 THEN 'moderate' ELSE 'low' END AS alignment,
  CASE WHEN pass_fcf_yield THEN 'pass' WHEN NOT pass_fcf_yield THEN 'fail' ELSE 'n/a' END AS fcf_yield FROM card""")
def _(spark, sf):
    out = fa.scorecard(analyzed(spark, sf))
    fcf = F.when(F.col("pass_fcf_yield"), "pass").when(~F.col("pass_fcf_yield"), "fail").otherwise("n/a")
    return rounded(out.select("symbol", "green_flags", "total_checks", "score_pct", "alignment", fcf.alias("fcf_yield")), 4)


_VAL = {"net_margin": "net_margin * 100", "gross_margin": "gross_margin_pct", "operating_margin": "operating_margin_pct", "roa": "roa_pct", "earnings_growth": "earnings_growth * 100", "roic": "roic_pct", "roe": "roe_pct"}


def _score(metric, low, high):
    v = _VAL.get(metric, metric)
    raw = f"100 * (1 - abs({v} - {low}) / {low})" if high is None else f"({v} - ({low})) / ({high - low}) * 100"
    return f"CASE WHEN {v} IS NOT NULL THEN greatest(0, least(100, ({raw})::DOUBLE)) END"


_FACT: dict = {}
for _f, _fw, _m, _l, _h in P.QUALITY_FACTORS:
    _FACT.setdefault(_f, (_fw, []))[1].append(_score(_m, _l, _h))
_FACT["stability"][1].append(f"CASE WHEN debt_to_equity IS NOT NULL THEN greatest(0, least(100, ((debt_to_equity - 2 * ({DE})) / (-2 * ({DE})) * 100)::DOUBLE)) END")
QUALITY = f"""qf AS (SELECT *, {', '.join(f'list_avg([{", ".join(parts)}])::DOUBLE AS q_{f}' for f, (_, parts) in _FACT.items())} FROM an),
  quality AS MATERIALIZED (SELECT *, ({' + '.join(f'coalesce(q_{f} * {w}, 0)' for f, (w, _) in _FACT.items())})::DOUBLE / nullif({' + '.join(f'(q_{f} IS NOT NULL)::INT * {w}' for f, (w, _) in _FACT.items())}, 0)::DOUBLE AS quality FROM qf)"""


@query("fa_company_quality", f"""WITH {ANALYZED}, {QUALITY} SELECT symbol, {cols([f'q_{f}' for f in _FACT], 4)}, round(quality, 4) AS quality,
  CASE WHEN quality >= 85 THEN 'Elite Quality' WHEN quality >= 70 THEN 'High Quality' WHEN quality >= 50 THEN 'Average Quality' WHEN quality >= 30 THEN 'Below Average' WHEN quality IS NOT NULL THEN 'Weak Quality' ELSE 'Not Ratable' END AS category FROM quality""")
def _(spark, sf):
    out = fa.company_quality(analyzed(spark, sf))
    return rounded(out.select("symbol", *[f"q_{f}" for f in _FACT], "quality", "category"), 4)


WATCH = """watch AS MATERIALIZED (SELECT symbol, sector, ((net_margin >= 0.10)::INT + coalesce((debt_to_equity > 0 AND debt_to_equity < 1)::INT, 0) + coalesce((current_ratio > 1.2)::INT, 0) + (pe_ratio BETWEEN 15 AND 45)::INT) / 4::DOUBLE * 100 AS score,
    pe_ratio, net_margin * 100 AS net_margin_pct FROM std WHERE nullif(pe_ratio, 0) IS NOT NULL AND nullif(net_margin, 0) IS NOT NULL)"""


@query("fa_watch_score", f"WITH {COMPANY}, {WATCH} SELECT symbol, sector, score, CASE WHEN score >= 75 THEN 'High' WHEN score >= 50 THEN 'Moderate' ELSE 'Low' END AS status, pe_ratio, round(net_margin_pct, 4) AS net_margin_pct FROM watch")
def _(spark, sf):
    return rounded(fa.watch_score(standardized(spark, sf)), 4)
