"""Holdings: daily value, cash flows, time- and money-weighted returns.

lots(portfolio, symbol, purchase_date, shares, cost) are summed per (portfolio, symbol, date) before any
shuffle by portfolio, so a portfolio with any number of trades shrinks to calendar size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import bfill, ffill, prev, sdiv
from barloom.session import stage


def valid_lots(lots: DataFrame, as_of: Column) -> DataFrame:
    """Adds the reasons why a lot cannot be accepted (empty when it can)."""
    reasons = F.concat_ws(
        "; ",
        F.when(~F.coalesce(F.col("shares") > 0, F.lit(False)), "shares must be positive"),
        F.when(~F.coalesce(F.col("cost") >= 0, F.lit(False)), "cost must not be negative"),
        F.when(F.col("purchase_date").isNull(), "purchase date is missing"),
        F.when(F.col("purchase_date") > as_of, "purchase date is in the future"),
    )
    return lots.withColumn("problems", reasons)


def merge_lots(lots: DataFrame) -> DataFrame:
    return lots.groupBy("portfolio", "symbol", "purchase_date").agg(
        F.sum("shares").alias("shares"), F.sum("cost").alias("cost"))


#: Contributions are summed as decimals of this kind, so that a long sum of changes does not drift.
MONEY = "decimal(38,10)"


def value_changes(lots: DataFrame, bars: DataFrame) -> DataFrame:
    """(portfolio, ts, value, paid, priced): by how much value and money paid in change at an instant; ``priced`` where there is a price.

    Lots and prices are interleaved per (portfolio, symbol).  An event changes the holding by shares x last price, or the price of what is held;
    what changes at one instant is summed over the symbols map-side.  There is a row per event, never one per day and symbol.
    """
    lots = merge_lots(lots)
    held = lots.groupBy("portfolio", "symbol").agg(F.min("purchase_date").alias("_first"))
    start = held.groupBy("portfolio").agg(F.min("_first").alias("_start"))
    pairs = held.join(start, "portfolio").select("portfolio", "symbol", "_start")
    prices = bars.select("symbol", "ts", "close").join(pairs, "symbol").where(F.col("ts") >= F.col("_start").cast("timestamp_ntz"))
    none = F.lit(None).cast("double")
    bought = lots.select("portfolio", "symbol", F.col("purchase_date").cast("timestamp_ntz").alias("ts"), none.alias("close"), "shares", "cost")
    timeline = bought.unionByName(prices.select("portfolio", "symbol", "ts", "close", none.alias("shares"), none.alias("cost")))
    timeline = timeline.withColumn("priced", F.col("close").isNotNull())
    key = ("portfolio", "symbol")
    moment = Window.partitionBy(*key).orderBy("ts", "priced")
    till = moment.rowsBetween(Window.unboundedPreceding, 0)
    run = timeline.select(
        *key, "ts", "priced", F.coalesce("cost", F.lit(0.0)).alias("paid"),
        (F.coalesce(F.sum("shares").over(till), F.lit(0.0)) * F.last("close", ignorenulls=True).over(till)).cast(MONEY).alias("_worth"))
    zero = F.lit(0).cast(MONEY)
    worth = F.coalesce("_worth", zero)
    step = run.withColumn("value", worth - F.coalesce(F.lag(worth).over(moment), zero))
    # symbols without any price count neither as value nor as money paid in
    known = bars.select("symbol").distinct()
    return step.join(known, "symbol", "left_semi").groupBy("portfolio", "ts").agg(
        F.sum("value").alias("value"), F.sum(F.col("paid").cast(MONEY)).alias("paid"), F.bool_or("priced").alias("priced"))


def value_series(lots: DataFrame, bars: DataFrame) -> DataFrame:
    """(portfolio, ts, value, flow): market value and money added on every trading day since the first purchase.

    One running sum of the changes; money paid in between two trading days arrives on the later one.
    """
    till = Window.partitionBy("portfolio").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    daily = value_changes(lots, bars).select(
        "portfolio", "ts", "priced", F.sum("value").over(till).cast("double").alias("value"), F.sum("paid").over(till).alias("_paid")).where("priced")
    before = prev(F.col("_paid"), key=("portfolio",))
    flow = (F.col("_paid") - F.coalesce(before, F.lit(0).cast(MONEY))).cast("double")
    return daily.select("portfolio", "ts", "value", flow.alias("flow"))


def time_weighted(series: DataFrame) -> DataFrame:
    """Product of daily returns net of flows, in percent; days after a zero value are skipped."""
    before = prev(F.col("value"), key=("portfolio",))
    step = series.withColumn("_b", before)
    factor = F.when(F.col("_b") > 0, 1 + (F.col("value") - F.col("_b") - F.col("flow")) / F.col("_b"))
    return step.withColumn("_f", factor).groupBy("portfolio").agg(
        F.when(F.count("_f") > 0, (F.product("_f") - 1) * 100).alias("twr_pct"), F.count(F.lit(1)).alias("days"))


def money_weighted(lots: DataFrame, final_value: DataFrame, steps: int = 80) -> DataFrame:
    """XIRR in percent by bisection on [-0.9999, 10]; NULL when no rate can exist.

    final_value(portfolio, end, value).  The cash-flow list of a portfolio has one entry per purchase day.
    """
    paid = lots.where(F.col("cost") > 0).groupBy("portfolio", "purchase_date").agg(F.sum("cost").alias("cost"))
    first = paid.groupBy("portfolio").agg(F.min("purchase_date").alias("_first"))
    years = lambda d: F.datediff(d, F.col("_first")) / 365.25
    outs = paid.join(first, "portfolio").groupBy("portfolio").agg(
        F.first("_first").alias("_first"), F.max("purchase_date").alias("_last"),
        F.array_sort(F.collect_list(F.struct(years(F.col("purchase_date")).alias("t"), (-F.col("cost")).alias("amount")))).alias("_out"))
    both = outs.join(final_value, "portfolio").withColumn(
        "_flows", F.concat("_out", F.array(F.struct(years(F.col("end")).alias("t"), F.col("value").alias("amount")))))

    def npv(rate: Column) -> Column:
        return F.aggregate("_flows", F.lit(0.0), lambda acc, f: acc + f["amount"] / F.pow(1 + rate, f["t"]))

    lo, hi = F.lit(-0.9999), F.lit(10.0)
    ends = both.withColumns({"_a": npv(lo), "_b": npv(hi)})
    solvable = (F.col("value") > 0) & (F.col("_a") * F.col("_b") <= 0) & (
        (F.col("_last") > F.col("_first")) | (F.col("end") > F.col("_first")))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        left = npv(mid) * F.col("_a") > 0
        return F.struct(F.when(left, mid).otherwise(acc["lo"]).alias("lo"), F.when(left, acc["hi"]).otherwise(mid).alias("hi"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(lo.alias("lo"), hi.alias("hi")), halve,
                       lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return ends.select("portfolio", F.when(solvable, root * 100).alias("mwr_pct"))


def rebased_benchmark(series: DataFrame, bench: DataFrame) -> DataFrame:
    """The benchmark on the portfolio's days (filled forward, then backward), scaled to the opening value."""
    key = ("portfolio",)
    step = series.select("portfolio", "ts", "value").join(bench, "ts", "left")
    step = step.withColumn("_fill", ffill(F.col("bench"), key))
    step = step.withColumn("_fill", bfill(F.col("_fill"), key))
    w = Window.partitionBy("portfolio").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    first, opening = F.first("_fill", ignorenulls=True).over(w), F.first("value").over(w)
    return step.select("portfolio", "ts", "value", (sdiv(F.col("_fill"), first) * opening).alias("benchmark"))


def lot_performance(lots: DataFrame, bars: DataFrame) -> DataFrame:
    """Market value and gain of every lot at the last price; unpriced lots say so."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    out = lots.join(last, "symbol", "left").withColumn("market_value", F.col("shares") * F.col("price"))
    gain = F.col("market_value") - F.col("cost")
    return out.withColumns({
        "gain": gain, "gain_pct": sdiv(gain, F.col("cost")) * 100,
        "unavailable": F.when(F.col("price").isNull(), "no price history available")})


def totals(perf: DataFrame) -> DataFrame:
    """Totals over the priced lots of every portfolio."""
    priced = F.col("market_value").isNotNull()
    return perf.groupBy("portfolio").agg(
        F.count_if(priced).alias("priced_lots"), F.count_if(~priced).alias("excluded_lots"),
        F.coalesce(F.sum("market_value"), F.lit(0.0)).alias("market_value"), F.sum(F.when(priced, F.col("cost"))).alias("cost"),
    ).withColumns({"gain": F.col("market_value") - F.col("cost"), "gain_pct": sdiv(F.col("market_value") - F.col("cost"), F.col("cost")) * 100})


def performance(lots: DataFrame, bars: DataFrame, bench: DataFrame, end: Column) -> DataFrame:
    """The summary line of every portfolio."""
    known = bars.select("symbol").distinct()
    priced = lots.join(known, "symbol", "left_semi")
    series = stage(value_series(priced, bars))
    final = series.groupBy("portfolio").agg(F.max_by("value", "ts").alias("value"), F.min("ts").alias("_s"), F.max("ts").alias("_e"))
    market = series.select("portfolio", "ts").join(bench, "ts").groupBy("portfolio").agg(
        F.when(F.count(F.lit(1)) >= 2, (sdiv(F.max_by("bench", "ts"), F.min_by("bench", "ts")) - 1) * 100).alias("benchmark_pct"))
    out = (
        totals(lot_performance(lots, bars)).join(time_weighted(series), "portfolio", "left")
        .join(money_weighted(priced, final.select("portfolio", end.alias("end"), "value")), "portfolio", "left")
        .join(market, "portfolio", "left")
    )
    note = F.when(F.col("days") < P.MIN_HOLDING_OBS, F.format_string("only %d trading days of history", F.col("days")))
    return out.withColumns({"excess_pct": F.col("twr_pct") - F.col("benchmark_pct"), "note": note})
