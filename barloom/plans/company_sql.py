"""SQL for statements, profiles and the standardized company row."""

YEARLY = """yr AS MATERIALIZED (SELECT 'S' || l_suppkey AS symbol, l_suppkey AS k, year(l_shipdate) AS yr, count(*) AS n, sum(l_quantity) AS qty,
  sum(l_extendedprice) AS ext, sum(l_extendedprice * (1 - l_discount)) AS rev, sum(l_extendedprice * (1 - l_discount) * l_tax) AS tax FROM lineitem GROUP BY ALL)"""
YEARLY_BRAND = """yr AS MATERIALIZED (SELECT p_brand AS symbol, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS k, year(l_shipdate) AS yr, count(*) AS n, sum(l_quantity) AS qty,
  sum(l_extendedprice) AS ext, sum(l_extendedprice * (1 - l_discount)) AS rev, sum(l_extendedprice * (1 - l_discount) * l_tax) AS tax
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""

ST = """op AS (SELECT *, rev - (0.4::DOUBLE + 0.05::DOUBLE * (k % 7)) * ext AS gp, (0.85::DOUBLE - 0.05::DOUBLE * (k % 4)) * ext AS eq FROM yr),
op2 AS (SELECT *, gp - 0.1::DOUBLE * ext - 100 * n AS oi, (gp - 0.1::DOUBLE * ext - 100 * n) * 1.02::DOUBLE AS e0,
  CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END * 0.02::DOUBLE * (1 + k % 3) * ext AS ie FROM op),
st AS MATERIALIZED (SELECT symbol, k, make_date(yr, 12, 31) AS period_end, rev AS revenue, CASE WHEN (k + yr) % 13 <> 5 AND k % 11 <> 3 THEN e0 END AS ebit_line,
  oi, e0 - abs(ie) - tax AS ni, CASE WHEN k % 7 <> 2 THEN ie END AS ie, CASE WHEN k % 5 <> 1 THEN gp END AS gp, e0 - abs(ie) AS pretax,
  CASE WHEN k % 9 <> 4 THEN tax END AS tax, 1.5::DOUBLE * ext AS ta, CASE WHEN k % 15 <> 6 THEN 0.5::DOUBLE * ext + 50 * qty END AS ca, 0.3::DOUBLE * ext AS cl,
  CASE WHEN k % 17 <> 6 THEN eq END AS eq, CASE WHEN k % 6 <> 5 THEN 1.5::DOUBLE * ext - eq END AS tl, CASE WHEN k % 12 <> 5 THEN 1.2::DOUBLE * ext - eq END AS ncl,
  CASE WHEN k % 8 <> 1 THEN 0.4::DOUBLE * ext END AS debt, 0.2::DOUBLE * rev AS re, CASE WHEN k % 5 <> 1 THEN 0.1::DOUBLE * ext END AS inv,
  CASE WHEN k % 4 <> 3 THEN 0.1::DOUBLE * ext END AS cash1, 0.12::DOUBLE * ext AS cash2, CASE WHEN (k + yr) % 4 <> 2 AND k % 13 <> 3 THEN 20000::DOUBLE + 1000 * (k % 7) END AS osn, CASE WHEN k % 26 <> 3 THEN 21000::DOUBLE + 1000 * (k % 7) END AS iss, CASE WHEN k % 14 <> 9 THEN oi * 0.6::DOUBLE END AS fcf,
  CASE WHEN k % 10 <> 7 THEN 0.05::DOUBLE * ext END AS da1, 0.04::DOUBLE * ext AS da2, -0.06::DOUBLE * rev AS capex,
  CASE WHEN k % 10 <> 2 THEN -0.02::DOUBLE * ext END AS nwc FROM op2)"""

PROFILE = """pf AS (SELECT symbol, k, sum(ext) AS ext, sum(rev) AS rev, max(yr) AS yr FROM yr GROUP BY ALL),
pf2 AS (SELECT *, CASE WHEN k % 19 = 0 THEN 0 ELSE (1 + k % 5) * 0.4::DOUBLE * ext END AS cap FROM pf),
profile AS MATERIALIZED (SELECT symbol, k, CASE WHEN k % 23 <> 22 THEN ['Technology', 'Financial Services', 'Utilities', 'Energy', 'Consumer Defensive'][k % 5 + 1] END AS sector,
  CASE WHEN k % 16 = 8 THEN -3 WHEN k % 13 <> 4 THEN 5 + k % 60 END::DOUBLE AS trailing_pe, (k % 9 - 1)::DOUBLE AS price_to_book, CASE WHEN k % 18 <> 7 THEN (k % 31 - 4) / 100::DOUBLE END AS profit_margins,
  (k % 41 - 5) / 100::DOUBLE AS return_on_equity, CASE WHEN k % 3 = 0 THEN 45 + k % 50 ELSE 0.3::DOUBLE + (k % 10) / 10::DOUBLE END::DOUBLE AS debt_to_equity,
  CASE WHEN k % 20 = 3 THEN 0 ELSE 0.6::DOUBLE + (k % 17) / 10::DOUBLE END AS current_ratio, 0.5::DOUBLE + (k % 11) / 10::DOUBLE AS quick_ratio,
  CASE WHEN k % 21 <> 5 THEN 0.4::DOUBLE + (k % 14) / 10::DOUBLE END AS beta, CASE WHEN k % 6 = 1 THEN 0 ELSE (k % 12 - 3) / 20::DOUBLE END AS earnings_growth,
  CASE WHEN k % 4 <> 1 THEN 0.07::DOUBLE END AS revenue_growth, 0.3::DOUBLE + (k % 8) / 40::DOUBLE AS gross_margins, 0.1::DOUBLE + (k % 6) / 40::DOUBLE AS operating_margins,
  (k % 9) / 50::DOUBLE AS return_on_assets, (4 + k % 20)::DOUBLE AS enterprise_to_ebitda, CASE WHEN k % 5 = 0 THEN 1.5::DOUBLE END AS peg_ratio, cap AS market_cap,
  CASE WHEN k % 22 = 9 THEN 0 ELSE cap / (20 + k % 80) END AS shares_outstanding, CASE WHEN k % 10 <> 6 THEN 20 + k % 80 END::DOUBLE AS quote_price,
  CASE WHEN k % 8 <> 6 THEN 20.5::DOUBLE + k % 79 END AS previous_close, CASE WHEN k % 16 <> 9 THEN 0.41::DOUBLE * ext END AS total_debt_reported,
  CASE WHEN k % 14 <> 2 THEN -0.02::DOUBLE * ext END AS interest_reported, CASE WHEN k % 3 <> 2 THEN (k % 7) / 4::DOUBLE END AS dividend_rate,
  CASE WHEN k % 12 <> 10 THEN (k % 30) / 100::DOUBLE END AS held_pct_insiders, CASE WHEN k % 15 <> 11 THEN 0.2::DOUBLE + (k % 60) / 100::DOUBLE END AS held_pct_institutions,
  CASE WHEN k % 9 <> 2 THEN make_date(yr, (k % 12 + 1)::INT, 28) END AS most_recent_quarter FROM pf2)"""

STD = """nw AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) = 1),
hi AS (SELECT symbol, CASE WHEN count(ebit_line) > 0 THEN avg(ebit_line / nullif(revenue, 0)) ELSE avg(oi / nullif(revenue, 0)) END AS normal_margin,
  coalesce(CASE WHEN count(da1) > 0 THEN avg(da1 / nullif(revenue, 0)) ELSE avg(da2 / nullif(revenue, 0)) END, 0) AS da_ratio,
  coalesce(avg(capex / nullif(revenue, 0)), 0) AS capex_ratio, coalesce(avg(nwc / nullif(revenue, 0)), 0) AS nwc_ratio FROM st GROUP BY symbol),
s0 AS (SELECT p.*, n.* EXCLUDE (symbol, k), h.* EXCLUDE (symbol), coalesce(debt, total_debt_reported) AS debt_any, abs(nullif(interest_reported, 0)) AS ir, cl + ncl AS dl,
  coalesce(debt, total_debt_reported, 0) / nullif(eq, 0) AS own_de, CASE WHEN abs(debt_to_equity) >= 5 THEN debt_to_equity / 100 ELSE debt_to_equity END AS given_de,
  CASE WHEN trailing_pe > 0 THEN trailing_pe END AS pe, coalesce(nullif(earnings_growth, 0), nullif(revenue_growth, 0)) AS growth FROM profile p LEFT JOIN nw n USING (symbol) LEFT JOIN hi h USING (symbol)),
std AS MATERIALIZED (SELECT symbol, k, sector, pe AS pe_ratio, CASE WHEN growth > 0 THEN pe / (growth * 100) END AS peg_ratio, CASE WHEN price_to_book > 0 THEN price_to_book END AS price_to_book,
  profit_margins AS net_margin, return_on_equity, coalesce(own_de, given_de) AS debt_to_equity, nullif(current_ratio, 0) AS current_ratio, beta, growth AS earnings_growth,
  held_pct_insiders, held_pct_institutions, nullif(market_cap, 0) AS market_cap, nullif(shares_outstanding, 0) AS shares, nullif(quote_price, 0) AS price,
  ta AS total_assets, ca AS current_assets, cl AS current_liabilities, eq AS equity, coalesce(tl, dl) AS total_liabilities, coalesce(debt_any, 0) AS total_debt, debt AS statement_debt,
  coalesce(re, 0) AS retained_earnings, coalesce(inv, 0) AS inventory, coalesce(cash1, cash2, 0) AS cash, revenue, coalesce(ebit_line, oi) AS ebit, coalesce(ie, ir) AS interest, ni AS net_income,
  gp AS gross_profit, oi AS operating_income, pretax AS pretax_income, tax AS tax_provision, fcf AS free_cash_flow, coalesce(da1, da2, 0) AS depreciation, most_recent_quarter,
  normal_margin, coalesce(da_ratio, 0) AS da_ratio, coalesce(capex_ratio, 0) AS capex_ratio, coalesce(nwc_ratio, 0) AS nwc_ratio,
  concat_ws(', ', CASE WHEN nullif(quote_price, 0) IS NOT NULL THEN 'price from quote' END, CASE WHEN debt IS NULL AND total_debt_reported IS NOT NULL THEN 'debt from profile' END,
    CASE WHEN ie IS NULL AND ir IS NOT NULL THEN 'interest from profile' END, CASE WHEN tl IS NULL AND dl IS NOT NULL THEN 'liabilities derived' END,
    CASE WHEN own_de IS NULL AND given_de IS NOT NULL THEN 'debt to equity from profile' END) AS fallbacks FROM s0)"""

# brand companies are priced by their bars, not by the quote
STD_PRICED = STD.replace("LEFT JOIN hi h USING (symbol)),", "LEFT JOIN hi h USING (symbol) LEFT JOIN lc USING (symbol)),").replace(
    "h.* EXCLUDE (symbol),", "h.* EXCLUDE (symbol), lc.last_close,").replace(
    "nullif(quote_price, 0) AS price,", "coalesce(last_close, nullif(quote_price, 0)) AS price,").replace(
    "CASE WHEN nullif(quote_price, 0) IS NOT NULL THEN 'price from quote' END", "CASE WHEN last_close IS NULL AND nullif(quote_price, 0) IS NOT NULL THEN 'price from quote' END")

AN = """tx AS (SELECT *, CASE WHEN pretax_income > 0 AND tax_provision / pretax_income BETWEEN 0 AND 0.5 THEN tax_provision / pretax_income END AS own_rate,
  coalesce(beta, 1) AS beta_used, CASE WHEN beta IS NOT NULL THEN 'reported' ELSE 'market assumption' END AS beta_source, CASE WHEN total_debt <> 0 THEN total_debt ELSE 1 END AS d1 FROM std),
an AS MATERIALIZED (SELECT *, coalesce(own_rate, 0.21::DOUBLE) AS tax_rate, own_rate IS NULL AS tax_fallback, gross_profit / nullif(revenue, 0) * 100 AS gross_margin_pct,
  operating_income / nullif(revenue, 0) * 100 AS operating_margin_pct, net_income / nullif(total_assets, 0) * 100 AS roa_pct, net_income / nullif(revenue, 0) * 100 AS net_margin_pct,
  net_income / nullif(equity, 0) * 100 AS roe_pct, current_assets / nullif(current_liabilities, 0) AS current_ratio_computed, (current_assets - inventory) / nullif(current_liabilities, 0) AS quick_ratio_computed,
  ebit / nullif(abs(interest), 0) AS interest_coverage, free_cash_flow / nullif(market_cap, 0) * 100 AS fcf_yield_pct, CASE WHEN net_income > 0 THEN market_cap / net_income END AS pe_computed,
  CASE WHEN equity > 0 THEN market_cap / equity END AS pb_computed, market_cap + total_debt - cash AS enterprise_value, ebit + depreciation AS ebitda, revenue / nullif(total_assets, 0) AS asset_turnover,
  ebit * (1 - coalesce(own_rate, 0.21::DOUBLE)) / nullif(total_debt + equity, 0) * 100 AS roic_pct,
  CASE WHEN ebit + depreciation > 0 THEN (market_cap + total_debt - cash) / (ebit + depreciation) END AS ev_ebitda,
  market_cap / (market_cap + d1) * (0.04::DOUBLE + beta_used * 0.06::DOUBLE) + d1 / (market_cap + d1) * (coalesce(abs(interest), 0) / d1 * 0.79::DOUBLE) AS wacc,
  CASE WHEN total_assets > 0 AND total_liabilities > 0 THEN 1.2::DOUBLE * (current_assets - current_liabilities) / total_assets + 1.4::DOUBLE * retained_earnings / total_assets
    + 3.3::DOUBLE * ebit / total_assets + 0.6::DOUBLE * market_cap / total_liabilities + 0.999::DOUBLE * revenue / total_assets END AS altman_z,
  concat_ws(', ', CASE WHEN total_assets IS NULL THEN 'Total Assets' END, CASE WHEN current_assets IS NULL THEN 'Current Assets' END, CASE WHEN current_liabilities IS NULL THEN 'Current Liabilities' END,
    CASE WHEN ebit IS NULL THEN 'EBIT' END, CASE WHEN revenue IS NULL THEN 'Total Revenue' END, CASE WHEN market_cap IS NULL THEN 'Market Cap' END, CASE WHEN total_liabilities IS NULL THEN 'Total Liabilities' END,
    CASE WHEN total_assets <= 0 THEN 'Total Assets not positive' END, CASE WHEN total_liabilities <= 0 THEN 'Total Liabilities not positive' END) AS altman_missing FROM tx)"""

COMPANY = f"{YEARLY}, {ST}, {PROFILE}, {STD}"
ANALYZED = f"{COMPANY}, {AN}"
LAST_CLOSE = "lc AS (SELECT symbol, arg_max(close, ts) AS last_close FROM bars GROUP BY symbol)"
BRAND_ANALYZED = f"{YEARLY_BRAND}, {ST}, {PROFILE}, {LAST_CLOSE}, {STD_PRICED}, {AN}"


def intrinsic(g: str, r: str) -> str:
    now = "coalesce(ebit / nullif(revenue, 0), normal_margin)"
    normal = f"coalesce(normal_margin, {now})"
    flows = [f"(revenue * pow(1 + {g}, {y}) * ({now} + ({normal} - {now}) * ({y}::DOUBLE / 5)) * 0.79::DOUBLE + revenue * pow(1 + {g}, {y}) * (da_ratio + capex_ratio + nwc_ratio))"
             for y in range(1, 6)]
    pv = " + ".join(f"{f} / pow(1 + {r}, {y})" for y, f in enumerate(flows, 1))
    return f"(({pv}) + {flows[-1]} * 1.02::DOUBLE / nullif({r} - 0.02::DOUBLE, 0) / pow(1 + {r}, 5)) / nullif(shares, 0)"


GATE = """CASE WHEN market_cap IS NULL THEN 'missing market cap' WHEN coalesce(shares, 0) <= 0 THEN 'missing shares outstanding' WHEN revenue IS NULL OR revenue <= 0 THEN 'missing or non-positive revenue'
  WHEN coalesce(normal_margin, ebit / nullif(revenue, 0)) IS NULL THEN 'no EBIT history' WHEN coalesce(normal_margin, ebit / nullif(revenue, 0)) <= 0 THEN 'negative average EBIT margin' END"""
