"""Point-in-time replay: every table cut at a date, run through the same operators.

The replay key is (symbol, as_of); a few dates multiply the rows by a constant and every replay is an
independent group.  Indicators never look ahead, so their replayed value is an as-of lookup on the full series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import sdiv
from barloom.operators import fundamentals as fa
from barloom.operators import indicators as ti
from barloom.operators import risk as rk
from barloom.session import stage

MIN_BARS = 30
KEY = ("symbol", "as_of")


def dates(as_of: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.lit(d).cast("date") for d in as_of]))


def bars_as_of(bars: DataFrame, as_of: Sequence[str]) -> DataFrame:
    return bars.withColumn("as_of", dates(as_of)).where(F.to_date("ts") <= F.col("as_of"))


def periods_as_of(periods: DataFrame, as_of: Sequence[str]) -> DataFrame:
    return periods.withColumn("as_of", dates(as_of)).where(F.col("period_end") <= F.col("as_of"))


def available_range(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def statement_periods(statements: DataFrame) -> DataFrame:
    return statements.select("symbol", "period_end").distinct()


def statement_period_for(statements: DataFrame, as_of: Sequence[str]) -> DataFrame:
    """The filing in force at each date (NULL when none was filed yet)."""
    asked = statements.select("symbol").distinct().withColumn("as_of", dates(as_of))
    known = periods_as_of(statement_periods(statements), as_of).groupBy(*KEY).agg(F.max("period_end").alias("statement_period"))
    return asked.join(known, list(KEY), "left")


def price_metrics(bars: DataFrame, as_of: Sequence[str]) -> DataFrame:
    """Price-derived metrics per (symbol, as_of); NULL under 30 bars."""
    cut = bars_as_of(bars.select("symbol", "ts", "close"), as_of)
    risk = rk.risk_metrics(cut, key=KEY)
    frame = ti.sma(ti.rsi(bars.select("symbol", "ts", "close")), (50, 200)).select("symbol", "ts", "rsi", "sma_50", "sma_200")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    tech = bars_as_of(frame, as_of).groupBy(*KEY).agg(newest("rsi"), newest("sma_50"), newest("sma_200"))
    both = risk.join(tech, list(KEY)).withColumnRenamed("last_close", "close")
    names = ("close", "rsi", "sma_50", "sma_200", "ann_vol", "rolling_vol", "hist_var", "expected_shortfall", "max_drawdown", "sharpe", "sortino", "calmar")
    enough = F.col("bars") >= MIN_BARS
    return both.select(*KEY, "bars", *[F.when(enough, F.col(n)).alias(n) for n in names])


def shares_as_of(periods: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Latest reported share count of the first alias that was ever reported."""
    latest = lambda a: F.max_by(F.col(f"`{a}`"), F.when(F.col(f"`{a}`").isNotNull(), F.col("period_end")))
    return periods.groupBy(*key).agg(F.coalesce(latest("Ordinary Shares Number"), latest("Share Issued")).alias("shares_then"))


def fundamentals_as_of(periods: DataFrame, profile: DataFrame, prices: DataFrame, as_of: Sequence[str]) -> DataFrame:
    """Scorecard inputs rebuilt from what was filed; only the sector survives from today's profile."""
    cut = periods_as_of(periods, as_of)
    i = lambda n: F.max_by(F.col(f"`{n}`"), F.col("period_end"))
    base = cut.groupBy(*KEY).agg(
        sdiv(i("Net Income"), i("Total Revenue")).alias("profit_margins"),
        sdiv(i("Current Assets"), i("Current Liabilities")).alias("current_ratio"), F.max("period_end").alias("statement_period"))
    base = base.join(shares_as_of(cut), list(KEY)).join(prices.select(*KEY, "close"), list(KEY), "left")
    joined = base.join(profile.select("symbol", "sector"), "symbol", "left")
    code = F.concat_ws("@", "symbol", F.col("as_of").cast("string"))
    none = F.lit(None).cast("double")
    blank = ("trailing_pe", "price_to_book", "return_on_equity", "debt_to_equity", "beta", "earnings_growth", "revenue_growth", "held_pct_insiders",
             "held_pct_institutions", "shares_outstanding", "quote_price", "total_debt_reported", "interest_reported")
    then = joined.select(
        code.alias("symbol"), "sector", "profit_margins", "current_ratio", (F.col("shares_then") * F.col("close")).alias("market_cap"),
        *[none.alias(b) for b in blank], F.lit(None).cast("date").alias("most_recent_quarter"), F.col("close").alias("last_close"))
    coded = cut.withColumn("symbol", code).drop("as_of")
    std = fa.standardize(coded, then.drop("last_close"), then.select("symbol", "last_close"))
    scored = fa.scorecard(fa.ratios(std)).withColumn("pe_ratio", F.col("pe_computed"))
    keys = joined.select(code.alias("symbol"), F.col("symbol").alias("_s"), "as_of", "statement_period")
    return scored.join(keys, "symbol").drop("symbol").withColumnRenamed("_s", "symbol")


# group, metric, column expression
ROWS = (
    ("Fundamentals", "Alignment", "score_pct"), ("Fundamentals", "Net Margin", "net_margin * 100"),
    ("Fundamentals", "Debt / Equity", "debt_to_equity"), ("Fundamentals", "Current Ratio", "current_ratio"),
    ("Fundamentals", "Altman Z", "altman_z"), ("Fundamentals", "P/E", "pe_ratio"), ("Fundamentals", "Market Cap", "market_cap"),
    ("Fundamentals", "Total Revenue", "revenue"), ("Fundamentals", "Net Income", "net_income"),
    ("Technicals", "Close", "close"), ("Technicals", "RSI", "rsi"), ("Technicals", "SMA 50", "sma_50"), ("Technicals", "SMA 200", "sma_200"),
    ("Risk", "Risk Score", "risk_score"), ("Risk", "Annual Volatility", "ann_vol * 100"), ("Risk", "VaR", "hist_var * 100"),
    ("Risk", "Expected Shortfall", "expected_shortfall * 100"), ("Risk", "Max Drawdown", "max_drawdown * 100"),
    ("Risk", "Sharpe", "sharpe"), ("Risk", "Sortino", "sortino"), ("Risk", "Calmar", "calmar"),
)


def _long(df: DataFrame, name: str) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(m).alias("metric"), F.expr(e).cast("double").alias(name)) for g, m, e in ROWS]))
    return df.select(*KEY, rows.alias("r")).select(*KEY, "r.*")


def _with_score(df: DataFrame) -> DataFrame:
    return rk.risk_score(df).withColumn("risk_score", F.when(F.col("close").isNotNull(), F.col("risk_score")))


def comparison(bars: DataFrame, periods: DataFrame, profile: DataFrame, as_of: Sequence[str], now: str) -> DataFrame:
    """(symbol, as_of, grp, metric, then, now, delta): 21 rows per symbol and date."""
    px = stage(price_metrics(bars, [*as_of, now]))
    then_px = px.where(F.col("as_of").isin([F.lit(d).cast("date") for d in as_of]))
    now_px = px.where(F.col("as_of") == F.lit(now).cast("date")).drop("as_of")
    funds = ("score_pct", "net_margin", "debt_to_equity", "current_ratio", "altman_z", "pe_ratio", "market_cap", "revenue", "net_income")
    then = stage(fundamentals_as_of(periods, profile, then_px, as_of).select(*KEY, *funds))
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close"))
    current = stage(fa.scorecard(fa.ratios(fa.standardize(periods, profile, last))).select("symbol", *funds))
    left = _long(_with_score(then_px.join(then, list(KEY), "left")), "then")
    asked = then_px.select(*KEY)
    right = _long(_with_score(asked.join(now_px, "symbol").join(current, "symbol", "left")), "now")
    both = left.join(right, [*KEY, "grp", "metric"], "full")
    return both.withColumn("delta", F.col("now") - F.col("then"))


def warnings(px: DataFrame, filings: DataFrame) -> DataFrame:
    """Why a replay is incomplete, per (symbol, as_of)."""
    few = F.when(F.coalesce("bars", F.lit(0)) < MIN_BARS, F.format_string("only %d bars", F.coalesce("bars", F.lit(0)).cast("long")))
    none = F.when(F.col("statement_period").isNull(), "no statement filed yet")
    return filings.join(px.select(*KEY, "bars"), list(KEY), "left").withColumn("warnings", F.concat_ws("; ", few, none))
