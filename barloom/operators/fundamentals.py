"""Statement standardization, ratios, scorecards and the valuation model, one row per company.

A company has one row per fiscal period, so the newest figure is a ``max_by`` and a historical average an
``avg``: one hash aggregate over the statement table, then plain column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.score import ideal, linear, mean_of, names_where, weighted
from barloom.functions.series import bands, sdiv
from barloom.operators import thresholds as th
from barloom.sources.companies import ITEMS

# --- fixed values: validated fields (statement, field, accepted items in order, required) ---
FIELDS = (
    ("balance", "Total Assets", ("Total Assets",), True),
    ("balance", "Current Assets", ("Current Assets",), True),
    ("balance", "Current Liabilities", ("Current Liabilities",), True),
    ("balance", "Stockholders Equity", ("Stockholders Equity",), True),
    ("balance", "Total Liabilities", ("Total Liabilities Net Minority Interest",), True),
    ("balance", "Total Debt", ("Total Debt",), False),
    ("balance", "Retained Earnings", ("Retained Earnings",), False),
    ("balance", "Inventory", ("Inventory",), False),
    ("balance", "Cash", ("Cash And Cash Equivalents", "Cash Cash Equivalents And Short Term Investments"), False),
    ("income", "Total Revenue", ("Total Revenue",), True),
    ("income", "EBIT", ("EBIT", "Operating Income"), True),
    ("income", "Net Income", ("Net Income",), True),
    ("income", "Interest Expense", ("Interest Expense",), False),
    ("income", "Gross Profit", ("Gross Profit",), False),
    ("income", "Operating Income", ("Operating Income",), False),
    ("income", "Pretax Income", ("Pretax Income",), False),
    ("income", "Tax Provision", ("Tax Provision",), False),
    ("cash", "Free Cash Flow", ("Free Cash Flow",), True),
    ("cash", "Depreciation And Amortization", ("Depreciation And Amortization", "Depreciation Amortization Depletion"), False),
)

ALL_ITEMS = [i for items in ITEMS.values() for i in items]


def by_period(statements: DataFrame) -> DataFrame:
    """Long statements -> one row per (symbol, period_end), one column per known item."""
    return statements.groupBy("symbol", "period_end").pivot("item", ALL_ITEMS).agg(F.first("value"))


def field(aliases) -> Column:
    """Newest period's value of the first alias that has one there (inside a group by symbol)."""
    return F.coalesce(*[F.max_by(F.col(f"`{a}`"), F.col("period_end")) for a in aliases])


def newest_fields(periods: DataFrame) -> DataFrame:
    """(symbol, <field>...) with NULL where the newest period does not report it."""
    return periods.groupBy("symbol").agg(*[field(a).alias(name) for _, name, a, _ in FIELDS])


def field_history(periods: DataFrame, aliases, name: str = "history") -> DataFrame:
    """Every (period, value) of the first alias with any value, oldest first."""
    pairs = [
        F.array_sort(F.collect_list(F.when(F.col(f"`{a}`").isNotNull(), F.struct("period_end", F.col(f"`{a}`").alias("value")))))
        for a in aliases]
    best = pairs[-1]
    for p in reversed(pairs[:-1]):
        best = F.when(F.size(p) > 0, p).otherwise(best)
    return periods.groupBy("symbol").agg(best.alias(name))


def validation(periods: DataFrame) -> DataFrame:
    """(symbol, statement, field, required, present): every expected field of every company."""
    wide = newest_fields(periods)
    rows = F.explode(F.array(*[
        F.struct(F.lit(s).alias("statement"), F.lit(n).alias("field"), F.lit(r).alias("required"),
                 F.col(f"`{n}`").isNotNull().alias("present")) for s, n, _, r in FIELDS]))
    return wide.select("symbol", rows.alias("f")).select("symbol", "f.*")


def statement_validity(checks: DataFrame) -> DataFrame:
    missing = lambda req: F.concat_ws(", ", F.array_sort(F.collect_list(
        F.when((F.col("required") == req) & ~F.col("present"), F.col("field")))))
    return checks.groupBy("symbol", "statement").agg(
        missing(True).alias("missing_required"), missing(False).alias("missing_optional"),
        F.bool_and(F.col("present") | ~F.col("required")).alias("is_valid"))


def completeness(present: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(sdiv(present, total) * 100)


# --- fixed values: data quality weights and freshness ---
QUALITY_WEIGHTS = {"required": 0.60, "optional": 0.15, "freshness": 0.15, "reliability": 0.10}
FRESH_DAYS, STALE_DAYS, UNKNOWN_FRESHNESS = 120, 365, 70.0


def data_quality(checks: DataFrame, status: DataFrame, as_of: Column) -> DataFrame:
    """Quality score per symbol; status(symbol, most_recent_quarter, errors, warnings)."""
    req, opt = F.col("required"), ~F.col("required")
    counts = checks.groupBy("symbol").agg(
        completeness(F.count_if(req & F.col("present")), F.count_if(req)).alias("required_pct"),
        completeness(F.count_if(opt & F.col("present")), F.count_if(opt)).alias("optional_pct"))
    joined = status.join(counts, "symbol", "left").fillna(0.0, ["required_pct", "optional_pct"])
    days = F.datediff(as_of, F.col("most_recent_quarter")).cast("long")
    fresh = (
        F.when(days.isNull(), UNKNOWN_FRESHNESS).when(days <= FRESH_DAYS, 100.0)
        .otherwise(F.greatest(F.lit(0.0), 100.0 - (days - FRESH_DAYS) / (STALE_DAYS - FRESH_DAYS) * 100.0)))
    reliable = F.greatest(F.lit(0.0), 100.0 - F.col("errors") * 30.0 - F.col("warnings") * 10.0)
    score = (QUALITY_WEIGHTS["required"] * F.col("required_pct") + QUALITY_WEIGHTS["optional"] * F.col("optional_pct")
             + QUALITY_WEIGHTS["freshness"] * fresh + QUALITY_WEIGHTS["reliability"] * reliable)
    return joined.select(
        "symbol", F.round(score, 1).alias("score"), quality_grade(score).alias("grade"),
        F.round("required_pct", 1).alias("required_pct"), F.round("optional_pct", 1).alias("optional_pct"),
        F.round(fresh, 1).alias("freshness"), F.round(reliable, 1).alias("reliability"), days.alias("staleness_days"),
        F.coalesce(days > FRESH_DAYS, F.lit(False)).alias("is_stale"))


def quality_grade(score: Column) -> Column:
    return bands(score, [(">=", 90, "Excellent"), (">=", 75, "Good"), (">=", 55, "Fair")], "Poor")


def normalize_debt_to_equity(raw: Column) -> Column:
    return F.when(F.abs(raw) >= 5, raw / 100).otherwise(raw)


def positive(raw: Column) -> Column:
    return F.when(raw > 0, raw)


def peg(pe: Column, growth: Column) -> Column:
    return F.when(growth > 0, sdiv(pe, growth * 100))


def _nonzero(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(0.0))


def standardize(periods: DataFrame, profile: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """One canonical row per profiled symbol; each secondary source used leaves a note in ``fallbacks``."""
    i = lambda name: F.col(f"`{name}`")
    rev = i("Total Revenue")
    ratio = lambda c: F.avg(F.when(c.isNotNull() & (rev != 0), c / rev))
    either = lambda a, b: F.when(F.count(i(a)) > 0, ratio(i(a))).otherwise(ratio(i(b)))
    newest = periods.groupBy("symbol").agg(
        *[field(a).alias(n) for _, n, a, _ in FIELDS],
        field(("Total Non Current Liabilities Net Minority Interest",)).alias("_ncl"),
        either("EBIT", "Operating Income").alias("normal_margin"),
        F.coalesce(either("Depreciation And Amortization", "Depreciation Amortization Depletion"), F.lit(0.0)).alias("da_ratio"),
        F.coalesce(ratio(i("Capital Expenditure")), F.lit(0.0)).alias("capex_ratio"),
        F.coalesce(ratio(i("Change In Working Capital")), F.lit(0.0)).alias("nwc_ratio"))
    j = profile.join(newest, "symbol", "left")
    j = j.join(prices, "symbol", "left") if prices is not None else j.withColumn("last_close", F.lit(None).cast("double"))

    quote = _nonzero("quote_price")
    debt = F.coalesce(i("Total Debt"), F.col("total_debt_reported"))
    reported_interest = F.abs(_nonzero("interest_reported"))
    derived_liabilities = F.col("Current Liabilities") + F.col("_ncl")
    equity = F.nullif(i("Stockholders Equity"), F.lit(0.0))
    own_de = sdiv(F.coalesce(debt, F.lit(0.0)), equity)
    given_de = normalize_debt_to_equity(F.col("debt_to_equity"))
    pe = positive(F.col("trailing_pe"))
    growth = F.coalesce(_nonzero("earnings_growth"), _nonzero("revenue_growth"))
    notes = names_where([
        (F.col("last_close").isNull() & quote.isNotNull(), "price from quote"),
        (i("Total Debt").isNull() & F.col("total_debt_reported").isNotNull(), "debt from profile"),
        (i("Interest Expense").isNull() & reported_interest.isNotNull(), "interest from profile"),
        (i("Total Liabilities").isNull() & derived_liabilities.isNotNull(), "liabilities derived"),
        (own_de.isNull() & given_de.isNotNull(), "debt to equity from profile"),
    ])
    return j.select(
        "symbol", "sector", pe.alias("pe_ratio"), peg(pe, growth).alias("peg_ratio"),
        positive(F.col("price_to_book")).alias("price_to_book"), F.col("profit_margins").alias("net_margin"),
        "return_on_equity", F.coalesce(own_de, given_de).alias("debt_to_equity"),
        _nonzero("current_ratio").alias("current_ratio"), "beta", growth.alias("earnings_growth"),
        "held_pct_insiders", "held_pct_institutions", _nonzero("market_cap").alias("market_cap"),
        _nonzero("shares_outstanding").alias("shares"), F.coalesce(F.col("last_close"), quote).alias("price"),
        i("Total Assets").alias("total_assets"), i("Current Assets").alias("current_assets"),
        i("Current Liabilities").alias("current_liabilities"), i("Stockholders Equity").alias("equity"),
        F.coalesce(i("Total Liabilities"), derived_liabilities).alias("total_liabilities"),
        F.coalesce(debt, F.lit(0.0)).alias("total_debt"), i("Total Debt").alias("statement_debt"),
        F.coalesce(i("Retained Earnings"), F.lit(0.0)).alias("retained_earnings"),
        F.coalesce("Inventory", F.lit(0.0)).alias("inventory"), F.coalesce("Cash", F.lit(0.0)).alias("cash"),
        rev.alias("revenue"), F.col("EBIT").alias("ebit"), F.coalesce(i("Interest Expense"), reported_interest).alias("interest"),
        i("Net Income").alias("net_income"), i("Gross Profit").alias("gross_profit"),
        i("Operating Income").alias("operating_income"), i("Pretax Income").alias("pretax_income"),
        i("Tax Provision").alias("tax_provision"), i("Free Cash Flow").alias("free_cash_flow"),
        F.coalesce(i("Depreciation And Amortization"), F.lit(0.0)).alias("depreciation"), "most_recent_quarter",
        "normal_margin", F.coalesce("da_ratio", F.lit(0.0)).alias("da_ratio"),
        F.coalesce("capex_ratio", F.lit(0.0)).alias("capex_ratio"), F.coalesce("nwc_ratio", F.lit(0.0)).alias("nwc_ratio"),
        notes.alias("fallbacks"))


def ratios(std: DataFrame, regressed: Column | None = None) -> DataFrame:
    """Adds every computed ratio, the distress score, beta and the cost of capital."""
    c = F.col
    pct = lambda a, b: sdiv(c(a), c(b)) * 100
    own_rate = F.when(c("pretax_income") > 0, sdiv(c("tax_provision"), c("pretax_income")))
    own_rate = F.when((own_rate >= 0) & (own_rate <= 0.5), own_rate)
    out = std.withColumns({
        "tax_rate": F.coalesce(own_rate, F.lit(P.TAX_RATE)), "tax_fallback": own_rate.isNull(),
        "gross_margin_pct": pct("gross_profit", "revenue"), "operating_margin_pct": pct("operating_income", "revenue"),
        "roa_pct": pct("net_income", "total_assets"), "net_margin_pct": pct("net_income", "revenue"),
        "roe_pct": pct("net_income", "equity"), "current_ratio_computed": sdiv(c("current_assets"), c("current_liabilities")),
        "quick_ratio_computed": sdiv(c("current_assets") - c("inventory"), c("current_liabilities")),
        "interest_coverage": sdiv(c("ebit"), F.abs("interest")), "fcf_yield_pct": pct("free_cash_flow", "market_cap"),
        "pe_computed": F.when(c("net_income") > 0, sdiv(c("market_cap"), c("net_income"))),
        "pb_computed": F.when(c("equity") > 0, sdiv(c("market_cap"), c("equity"))),
        "enterprise_value": c("market_cap") + c("total_debt") - c("cash"), "ebitda": c("ebit") + c("depreciation"),
        "asset_turnover": sdiv(c("revenue"), c("total_assets")),
        "beta_used": F.coalesce(*([regressed] if regressed is not None else []), c("beta"), F.lit(1.0)),
        "beta_source": (F.when(regressed.isNotNull(), "regressed") if regressed is not None else F.when(F.lit(False), ""))
        .when(c("beta").isNotNull(), "reported").otherwise("market assumption"),
    })
    debt = F.when(c("total_debt") != 0, c("total_debt")).otherwise(1.0)
    interest = F.coalesce(F.abs("interest"), F.lit(0.0))
    cost_equity = P.RISK_FREE + c("beta_used") * (P.MARKET_RETURN - P.RISK_FREE)
    cost_debt = interest / debt * (1 - P.TAX_RATE)
    total = c("market_cap") + debt
    needed = [("total_assets", "Total Assets"), ("current_assets", "Current Assets"), ("current_liabilities", "Current Liabilities"),
              ("ebit", "EBIT"), ("revenue", "Total Revenue"), ("market_cap", "Market Cap"), ("total_liabilities", "Total Liabilities")]
    z = (1.2 * sdiv(c("current_assets") - c("current_liabilities"), c("total_assets"))
         + 1.4 * sdiv(c("retained_earnings"), c("total_assets")) + 3.3 * sdiv(c("ebit"), c("total_assets"))
         + 0.6 * sdiv(c("market_cap"), c("total_liabilities")) + 0.999 * sdiv(c("revenue"), c("total_assets")))
    usable = (c("total_assets") > 0) & (c("total_liabilities") > 0)
    out = out.withColumns({
        "roic_pct": sdiv(c("ebit") * (1 - c("tax_rate")), c("total_debt") + c("equity")) * 100,
        "ev_ebitda": F.when(c("ebitda") > 0, sdiv(c("enterprise_value"), c("ebitda"))),
        "wacc": sdiv(c("market_cap"), total) * cost_equity + sdiv(debt, total) * cost_debt,
        "altman_z": F.when(usable, z),
        "altman_missing": names_where([(c(n).isNull(), label) for n, label in needed]
                                      + [(c(n) <= 0, f"{label} not positive") for n, label in (needed[0], needed[-1])]),
    })
    return out.withColumn("altman_zone", altman_zone(c("altman_z")))


def altman_zone(z: Column, safe: Column | float = P.ALTMAN_SAFE, grey: Column | float = P.ALTMAN_GREY) -> Column:
    return F.when(z > safe, "safe").when(z >= grey, "grey").when(z.isNotNull(), "distress").otherwise("insufficient data")


def intrinsic_price(growth: Column, discount: Column) -> Column:
    """Value per share: five projected years with the margin fading to normal, then a terminal value."""
    c, years = F.col, P.PROJECTION_YEARS
    now = F.coalesce(sdiv(c("ebit"), c("revenue")), c("normal_margin"))
    normal = F.coalesce(c("normal_margin"), now)
    extra = c("da_ratio") + c("capex_ratio") + c("nwc_ratio")
    value, flow = F.lit(0.0), None
    for y in range(1, years + 1):
        revenue = c("revenue") * F.pow(1 + growth, F.lit(float(y)))
        margin = now + (normal - now) * (y / years)
        flow = revenue * margin * (1 - P.TAX_RATE) + revenue * extra
        value = value + sdiv(flow, F.pow(1 + discount, F.lit(float(y))))
    terminal = sdiv(flow * (1 + P.TERMINAL_GROWTH), discount - P.TERMINAL_GROWTH)
    return sdiv(value + sdiv(terminal, F.pow(1 + discount, F.lit(float(years)))), c("shares"))


def dcf_gate() -> Column:
    c = F.col
    anchor = F.coalesce(c("normal_margin"), sdiv(c("ebit"), c("revenue")))
    return (
        F.when(c("market_cap").isNull(), "missing market cap")
        .when(F.coalesce(c("shares"), F.lit(0.0)) <= 0, "missing shares outstanding")
        .when(c("revenue").isNull() | (c("revenue") <= 0), "missing or non-positive revenue")
        .when(anchor.isNull(), "no EBIT history").when(anchor <= 0, "negative average EBIT margin"))


def dcf(analyzed: DataFrame, growth: float) -> DataFrame:
    g = F.lit(float(growth))
    out = analyzed.withColumn("dcf_reason", dcf_gate())
    ok = F.col("dcf_reason").isNull()
    out = out.withColumn("intrinsic", F.when(ok, intrinsic_price(g, F.col("wacc"))))
    safety = sdiv(F.col("intrinsic") - F.col("price"), F.col("intrinsic")) * 100
    return out.withColumns({
        "safety_pct": safety,
        "dcf_status": bands(safety, [(">=", P.STRONG_BUY_MARGIN, "Strong Buy"), (">", 0, "Buy")], "Overvalued")})


def dcf_grid(analyzed: DataFrame, growth: float) -> DataFrame:
    """The valuation at 3 discount x 3 growth rates around the base case, floored at 1%."""
    n = P.GRID_STEPS
    cells = F.explode(F.array(*[F.struct(F.lit(i / (n - 1)).alias("w"), F.lit(j / (n - 1)).alias("g"))
                                for i in range(n) for j in range(n)]))
    between = lambda base, delta, share: (
        F.greatest(F.lit(0.01), base - delta) + (base + delta - F.greatest(F.lit(0.01), base - delta)) * share)
    grid = analyzed.where(dcf_gate().isNull()).withColumn("_c", cells).withColumns({
        "discount": between(F.col("wacc"), P.GRID_WACC_DELTA, F.col("_c.w")),
        "growth": between(F.lit(float(growth)), P.GRID_GROWTH_DELTA, F.col("_c.g"))})
    return grid.select("symbol", "discount", "growth", intrinsic_price(F.col("growth"), F.col("discount")).alias("intrinsic"))


def agrees(computed: Column, reference: Column) -> Column:
    return F.abs(computed - reference) / F.greatest(F.abs(reference), F.lit(1e-9)) <= P.AGREEMENT_TOLERANCE


# report category, metric, computed column, reported figure (None: no counterpart)
REPORT = (
    ("Profitability", "net_margin", "net_margin_pct", "profit_margins * 100"),
    ("Profitability", "gross_margin", "gross_margin_pct", "gross_margins * 100"),
    ("Profitability", "operating_margin", "operating_margin_pct", "operating_margins * 100"),
    ("Profitability", "roa", "roa_pct", "return_on_assets * 100"),
    ("Profitability", "roe", "roe_pct", "reported_roe * 100"),
    ("Profitability", "roic", "roic_pct", None),
    ("Liquidity", "current_ratio", "current_ratio_computed", "reported_current_ratio"),
    ("Liquidity", "quick_ratio", "quick_ratio_computed", "quick_ratio"),
    ("Leverage", "debt_to_equity", "debt_to_equity", "reported_de"),
    ("Leverage", "total_debt", "statement_debt / 1e9", "total_debt_reported / 1e9"),
    ("Leverage", "interest_coverage", "interest_coverage", None),
    ("Valuation", "pe_ratio", "pe_computed", "pe_ratio"),
    ("Valuation", "price_to_book", "pb_computed", "price_to_book"),
    ("Valuation", "peg_ratio", "peg_ratio", "reported_peg"),
    ("Valuation", "ev_ebitda", "ev_ebitda", "enterprise_to_ebitda"),
    ("Valuation", "fcf_yield", "fcf_yield_pct", None),
)


def validation_report(analyzed: DataFrame, profile: DataFrame) -> DataFrame:
    """(symbol, category, metric, computed, reported, agrees, outlier): sixteen rows per symbol."""
    ref = profile.select(
        "symbol", "profit_margins", "gross_margins", "operating_margins", "return_on_assets", "quick_ratio", "total_debt_reported",
        "enterprise_to_ebitda", F.col("return_on_equity").alias("reported_roe"), F.col("current_ratio").alias("reported_current_ratio"),
        normalize_debt_to_equity(F.col("debt_to_equity")).alias("reported_de"), F.col("peg_ratio").alias("reported_peg"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(cat).alias("category"), F.lit(m).alias("metric"), F.expr(x).cast("double").alias("computed"),
                 (F.expr(y) if y else F.lit(None)).cast("double").alias("reported")) for cat, m, x, y in REPORT]))
    long = analyzed.join(ref, "symbol").select("symbol", rows.alias("r")).select("symbol", "r.*")
    over = F.lit(False)
    for metric, limit, symmetric in P.OUTLIER_BOUNDS:
        size = F.abs("computed") if symmetric else F.col("computed")
        over = F.when(F.col("metric") == metric, F.coalesce(size > limit, F.lit(False))).otherwise(over)
    return long.withColumns({"agrees": agrees(F.col("computed"), F.col("reported")), "outlier": over})


def validation_summary(report: DataFrame, analyzed: DataFrame) -> DataFrame:
    counts = report.groupBy("symbol").agg(
        F.count("computed").alias("evaluated"), F.count_if(~F.col("agrees")).alias("disagreements"),
        F.count_if("outlier").alias("outliers"))
    notes = analyzed.select("symbol", (
        F.when(F.col("fallbacks") == "", 0).otherwise(F.size(F.split("fallbacks", ", "))) + F.col("tax_fallback").cast("int")
    ).cast("long").alias("fallbacks"))
    out = counts.join(notes, "symbol")
    total = F.col("disagreements") + F.col("outliers") + F.col("fallbacks")
    return out.withColumns({"issues": total, "is_clean": total == 0})


def max_debt_to_equity(sector: Column, limits: dict[str, Column] | None = None) -> Column:
    limits = limits or th.shipped()
    return F.when(sector.isin(*P.FINANCIAL_SECTORS), limits["financials_max_debt_to_equity"]).otherwise(limits["max_debt_to_equity"])


def pe_bounds(sector: Column, limits: dict[str, Column] | None = None, bands: Column | None = None) -> tuple[Column, Column]:
    """The P/E band of a sector: from the table ``bands`` (shipped if none), else the general band."""
    limits = limits or th.shipped()
    low, high = limits["pe_range_low"], limits["pe_range_high"]
    if bands is not None:
        return F.coalesce(bands[sector]["lo"], low), F.coalesce(bands[sector]["hi"], high)
    for name, (lo, hi) in P.SECTOR_PE.items():
        low, high = F.when(sector == name, lo).otherwise(low), F.when(sector == name, hi).otherwise(high)
    return low, high


CHECKS = ("net_margin", "debt_to_equity", "roic", "fcf_yield", "interest_coverage", "pe_ratio", "peg_ratio", "beta", "current_ratio")


def checks(analyzed: DataFrame, limits: dict[str, Column] | None = None, bands_of: Column | None = None) -> DataFrame:
    """Adds pass_<metric> (NULL when it cannot be evaluated) against sector-adjusted thresholds, the shipped ones if none are given."""
    c, t = F.col, limits or th.shipped()
    lo, hi = pe_bounds(c("sector"), t, bands_of)
    tests = {
        "net_margin": c("net_margin") >= t["min_net_margin"], "debt_to_equity": c("debt_to_equity") < max_debt_to_equity(c("sector"), t),
        "roic": c("roic_pct") > t["min_roic_pct"], "fcf_yield": c("fcf_yield_pct") > t["min_fcf_yield_pct"],
        "interest_coverage": c("interest_coverage") > t["min_interest_coverage"],
        "pe_ratio": (c("pe_ratio") >= lo) & (c("pe_ratio") <= hi),
        "peg_ratio": (c("peg_ratio") > t["peg_range_low"]) & (c("peg_ratio") <= t["peg_range_high"]),
        "beta": c("beta") < t["max_beta"], "current_ratio": c("current_ratio") > t["min_current_ratio"],
    }
    return analyzed.withColumns({f"pass_{k}": v for k, v in tests.items()})


def scorecard(analyzed: DataFrame, limits: dict[str, Column] | None = None, bands_of: Column | None = None) -> DataFrame:
    """Green flags, evaluable checks, weighted score and verdict."""
    t = limits or th.shipped()
    out = checks(analyzed, t, bands_of)
    parts = [(F.col(f"pass_{m}").cast("double") * 100, w) for m, w in P.SCORE_WEIGHTS.items()]
    count = lambda test: sum((F.coalesce(test(F.col(f"pass_{m}")).cast("long"), F.lit(0)) for m in P.SCORE_WEIGHTS), F.lit(0)).cast("long")
    score = weighted(parts, empty=0.0)
    return out.withColumns({
        "green_flags": count(lambda p: p), "total_checks": count(lambda p: p.isNotNull()), "score_pct": score,
        "alignment": F.when(score >= t["high_alignment_pct"], "high").when(score >= t["moderate_alignment_pct"], "moderate").otherwise("low")})


def scorecard_by_user(analyzed: DataFrame, follows: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """The scorecards of followed companies, with the distress zone, by the thresholds of the user."""
    limits = th.of_class()

    def score(rows: DataFrame) -> DataFrame:
        zone = altman_zone(F.col("altman_z"), limits["altman_safe_zone"], limits["altman_grey_zone"])
        return scorecard(rows, limits, F.col("th_bands")).withColumn("altman_zone", zone)

    return th.for_followers(analyzed, follows, members, classes, score)


def company_quality(analyzed: DataFrame) -> DataFrame:
    """Factor scores (mean of the computable metrics), their weighted mean, and the category."""
    c = F.col
    values = {
        "net_margin": c("net_margin") * 100, "gross_margin": c("gross_margin_pct"), "operating_margin": c("operating_margin_pct"),
        "roa": c("roa_pct"), "current_ratio": c("current_ratio"), "interest_coverage": c("interest_coverage"),
        "altman_z": c("altman_z"), "earnings_growth": c("earnings_growth") * 100, "pe_ratio": c("pe_ratio"), "peg_ratio": c("peg_ratio"),
        "price_to_book": c("price_to_book"), "ev_ebitda": c("ev_ebitda"), "roic": c("roic_pct"), "roe": c("roe_pct"),
        "asset_turnover": c("asset_turnover"),
    }
    factors: dict[str, list[Column]] = {}
    weights: dict[str, float] = {}
    for factor, weight, metric, low, high in P.QUALITY_FACTORS:
        score = ideal(values[metric], low) if high is None else linear(values[metric], low, high)
        factors.setdefault(factor, []).append(score)
        weights[factor] = weight
    factors["stability"].append(linear(c("debt_to_equity"), max_debt_to_equity(c("sector")) * P.DEBT_ZERO_POINT, 0.0))
    out = analyzed.withColumns({f"q_{f}": mean_of(parts) for f, parts in factors.items()})
    overall = weighted([(c(f"q_{f}"), w) for f, w in weights.items()])
    elite, high, average, below = P.QUALITY_BANDS
    category = bands(overall, [(">=", elite, "Elite Quality"), (">=", high, "High Quality"), (">=", average, "Average Quality"), (">=", below, "Below Average")], "Weak Quality")
    return out.withColumns({"quality": overall, "category": F.coalesce(category, F.lit("Not Ratable"))})


def watch_score(std: DataFrame) -> DataFrame:
    """The four-flag basket screen; companies without P/E or margin are left out."""
    c = F.col
    flag = lambda t: F.coalesce(t.cast("int"), F.lit(0))
    flags = (
        flag(c("net_margin") >= P.WATCH_MIN_MARGIN) + flag((c("debt_to_equity") > 0) & (c("debt_to_equity") < P.WATCH_MAX_DE))
        + flag(c("current_ratio") > P.WATCH_MIN_CURRENT) + flag((c("pe_ratio") >= P.WATCH_PE[0]) & (c("pe_ratio") <= P.WATCH_PE[1])))
    score = flags / 4 * 100
    return std.where(F.nullif("pe_ratio", F.lit(0.0)).isNotNull() & F.nullif("net_margin", F.lit(0.0)).isNotNull()).select(
        "symbol", "sector", score.alias("score"), bands(score, [(">=", 75, "High"), (">=", 50, "Moderate")], "Low").alias("status"),
        "pe_ratio", (c("net_margin") * 100).alias("net_margin_pct"))
