"""Company tables derived from the star schema: statements and profiles of suppliers or brands.

Line items are aggregated per (company, year) with map-side partials, so a company with a third of all
lines costs no more than any other.  Some items are withheld by the company number, so that every
fallback and every missing-value path has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.tables import table

# --- fixed values: statement items by statement ---
ITEMS = {
    "income": ("Total Revenue", "EBIT", "Operating Income", "Net Income", "Interest Expense", "Gross Profit",
               "Pretax Income", "Tax Provision"),
    "balance": ("Total Assets", "Current Assets", "Current Liabilities", "Stockholders Equity",
                "Total Liabilities Net Minority Interest", "Total Non Current Liabilities Net Minority Interest",
                "Total Debt", "Retained Earnings", "Inventory", "Cash And Cash Equivalents",
                "Cash Cash Equivalents And Short Term Investments", "Ordinary Shares Number", "Share Issued"),
    "cash": ("Free Cash Flow", "Depreciation And Amortization", "Depreciation Amortization Depletion",
             "Capital Expenditure", "Change In Working Capital"),
}
SECTORS = ("Technology", "Financial Services", "Utilities", "Energy", "Consumer Defensive")


def yearly(spark: SparkSession, folder: str, by: str = "supplier") -> DataFrame:
    """(symbol, k, yr, n, qty, ext, rev, tax) of every company and year."""
    lines = table(spark, folder, "lineitem")
    if by == "supplier":
        keyed = lines.withColumns({"k": F.col("l_suppkey"), "symbol": F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))})
    else:
        parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
        keyed = lines.join(parts, lines.l_partkey == parts.p_partkey).withColumn(
            "k", F.regexp_extract("symbol", r"(\d+)", 1).cast("long"))
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return keyed.groupBy("symbol", "k", F.year("l_shipdate").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("ext"),
        F.sum(rev).alias("rev"), F.sum(rev * F.col("l_tax")).alias("tax"))


def _unless(k: Column, mod: int, rest: int, value: Column) -> Column:
    return F.when(k % mod != rest, value)


def statement_rows(years: DataFrame) -> DataFrame:
    """One row per (symbol, period_end) with one column per item; withheld items are NULL."""
    k, ext, rev = F.col("k"), F.col("ext"), F.col("rev")
    gp = rev - (0.4 + 0.05 * (k % 7)) * ext
    op = gp - 0.1 * ext - 100 * F.col("n")
    ebit = op * 1.02
    interest = F.when(k % 2 == 0, -1.0).otherwise(1.0) * 0.02 * (1 + k % 3) * ext
    pretax = ebit - F.abs(interest)
    equity = (0.85 - 0.05 * (k % 4)) * ext
    cols = {
        "Total Revenue": rev,
        "EBIT": F.when((k + F.col("yr")) % 13 != 5, _unless(k, 11, 3, ebit)),
        "Operating Income": op,
        "Net Income": pretax - F.col("tax"),
        "Interest Expense": _unless(k, 7, 2, interest),
        "Gross Profit": _unless(k, 5, 1, gp),
        "Pretax Income": pretax,
        "Tax Provision": _unless(k, 9, 4, F.col("tax")),
        "Total Assets": 1.5 * ext,
        "Current Assets": _unless(k, 15, 6, 0.5 * ext + 50 * F.col("qty")),
        "Current Liabilities": 0.3 * ext,
        "Stockholders Equity": _unless(k, 17, 6, equity),
        "Total Liabilities Net Minority Interest": _unless(k, 6, 5, 1.5 * ext - equity),
        "Total Non Current Liabilities Net Minority Interest": _unless(k, 12, 5, 1.2 * ext - equity),
        "Total Debt": _unless(k, 8, 1, 0.4 * ext),
        "Retained Earnings": 0.2 * rev,
        "Inventory": _unless(k, 5, 1, 0.1 * ext),
        "Cash And Cash Equivalents": _unless(k, 4, 3, 0.1 * ext),
        "Cash Cash Equivalents And Short Term Investments": 0.12 * ext,
        "Ordinary Shares Number": F.when((k + F.col("yr")) % 4 != 2, _unless(k, 13, 3, 20000.0 + 1000.0 * (k % 7))),
        "Share Issued": _unless(k, 26, 3, 21000.0 + 1000.0 * (k % 7)),
        "Free Cash Flow": _unless(k, 14, 9, op * 0.6),
        "Depreciation And Amortization": _unless(k, 10, 7, 0.05 * ext),
        "Depreciation Amortization Depletion": 0.04 * ext,
        "Capital Expenditure": -0.06 * rev,
        "Change In Working Capital": _unless(k, 10, 2, -0.02 * ext),
    }
    return years.select("symbol", F.make_date("yr", F.lit(12), F.lit(31)).alias("period_end"), *[c.alias(n) for n, c in cols.items()])


def statements(years: DataFrame) -> DataFrame:
    """Long statements(symbol, statement, item, period_end, value), without rows for withheld items."""
    names = [i for items in ITEMS.values() for i in items]
    kind = F.create_map(*[F.lit(x) for s, items in ITEMS.items() for i in items for x in (i, s)])
    long = statement_rows(years).unpivot(["symbol", "period_end"], names, "item", "value")
    return long.where(F.col("value").isNotNull()).select("symbol", kind[F.col("item")].alias("statement"), "item", "period_end", "value")


def profiles(years: DataFrame) -> DataFrame:
    """profile(symbol, sector, ...): the reported figures of every company, with gaps."""
    k = F.col("k")
    whole = years.groupBy("symbol", "k").agg(F.sum("ext").alias("ext"), F.sum("rev").alias("rev"), F.max("yr").alias("yr"))
    cap = F.when(k % 19 == 0, 0.0).otherwise((1 + k % 5) * 0.4 * F.col("ext"))
    cols = {
        "sector": F.when(k % 23 != 22, F.element_at(F.array(*[F.lit(s) for s in SECTORS]), (k % 5 + 1).cast("int"))),
        "trailing_pe": F.when(k % 16 == 8, -3.0).when(k % 13 != 4, 5.0 + k % 60),
        "price_to_book": (k % 9) - 1.0,
        "profit_margins": F.when(k % 18 != 7, ((k % 31) - 4) / 100.0),
        "return_on_equity": ((k % 41) - 5) / 100.0,
        "debt_to_equity": F.when(k % 3 == 0, 45.0 + k % 50).otherwise(0.3 + (k % 10) / 10.0),
        "current_ratio": F.when(k % 20 == 3, 0.0).otherwise(0.6 + (k % 17) / 10.0),
        "quick_ratio": 0.5 + (k % 11) / 10.0,
        "beta": F.when(k % 21 != 5, 0.4 + (k % 14) / 10.0),
        "earnings_growth": F.when(k % 6 == 1, 0.0).otherwise(((k % 12) - 3) / 20.0),
        "revenue_growth": F.when(k % 4 != 1, 0.07),
        "gross_margins": 0.3 + (k % 8) / 40.0,
        "operating_margins": 0.1 + (k % 6) / 40.0,
        "return_on_assets": (k % 9) / 50.0,
        "enterprise_to_ebitda": 4.0 + k % 20,
        "peg_ratio": F.when(k % 5 == 0, 1.5),
        "market_cap": cap,
        "shares_outstanding": F.when(k % 22 == 9, 0.0).otherwise(cap / (20 + k % 80)),
        "quote_price": F.when(k % 10 != 6, 20.0 + k % 80),
        "previous_close": F.when(k % 8 != 6, 20.5 + k % 79),
        "total_debt_reported": F.when(k % 16 != 9, 0.41 * F.col("ext")),
        "interest_reported": F.when(k % 14 != 2, -0.02 * F.col("ext")),
        "dividend_rate": F.when(k % 3 != 2, (k % 7) / 4.0),
        "held_pct_insiders": F.when(k % 12 != 10, (k % 30) / 100.0),
        "held_pct_institutions": F.when(k % 15 != 11, 0.2 + (k % 60) / 100.0),
        "most_recent_quarter": F.when(k % 9 != 2, F.make_date("yr", (k % 12 + 1).cast("int"), F.lit(28))),
    }
    return whole.select("symbol", *[c.alias(n) for n, c in cols.items()])
