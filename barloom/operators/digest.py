"""Period digests, strengths and concerns, verdicts and read-only views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import sdiv
from barloom.operators import risk as rk


def watch_symbols(lists: DataFrame) -> DataFrame:
    """Distinct symbols of every owner with the position of the first mention."""
    return lists.groupBy("owner", "symbol").agg(F.min("pos").alias("pos"))


def moves(symbols: DataFrame, bars: DataFrame, end: Column, days: int) -> DataFrame:
    """First to last close inside the window, in percent, or the reason why not."""
    inside = bars.where((F.to_date("ts") >= F.date_sub(end, days)) & (F.to_date("ts") < end) & F.col("close").isNotNull())
    ends = inside.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("close", "ts").alias("start_price"), F.max_by("close", "ts").alias("end_price"))
    out = symbols.select("symbol").distinct().join(ends, "symbol", "left")
    reason = (
        F.when(F.col("_n").isNull(), "no closes").when(F.col("_n") < 2, "a single close")
        .when(F.col("start_price") == 0, "first close is zero"))
    ok = reason.isNull()
    change = sdiv(F.col("end_price") - F.col("start_price"), F.col("start_price")) * 100
    return out.select("symbol", F.when(ok, F.col("start_price")).alias("start_price"), F.when(ok, F.col("end_price")).alias("end_price"),
                      F.when(ok, change).alias("change_pct"), reason.alias("unavailable"))


def fired_since(history: DataFrame, since: Column) -> DataFrame:
    return history.where(F.col("ts") >= since)


def breach_lines(triggered: DataFrame) -> DataFrame:
    text = F.concat(F.col("symbol"), F.lit("  "), F.col("metric"), F.lit(" "), F.col("op"), F.lit(" "), F.format_string("%.2f", F.col("threshold")),
                    F.format_string("  (now %.4f)", F.col("value")))
    return triggered.withColumn("line", text)


def _counts(lists: DataFrame, moved: DataFrame, fired: DataFrame, breaches: DataFrame) -> DataFrame:
    """Per owner: symbols, priced ones, alerts, breaches and the largest move.

    Symbol-level counts are joined to the watch lists before grouping, so nothing is gathered per owner.
    """
    names = watch_symbols(lists)
    n_fired = fired.groupBy("symbol").agg(F.count(F.lit(1)).alias("_f"))
    n_breach = breaches.groupBy("owner", "symbol").agg(F.count(F.lit(1)).alias("_b"))
    rows = names.join(moved, "symbol", "left").join(n_fired, "symbol", "left").join(n_breach, ["owner", "symbol"], "left")
    # equal moves: the later name
    size = F.when(F.col("change_pct").isNotNull(), F.struct(F.abs("change_pct"), F.col("symbol")))
    return rows.groupBy("owner").agg(
        F.count(F.lit(1)).alias("symbols"), F.count("change_pct").alias("priced"),
        F.coalesce(F.sum("_f"), F.lit(0)).alias("alerts"), F.coalesce(F.sum("_b"), F.lit(0)).alias("breaches"),
        F.max_by("symbol", size).alias("top_symbol"), F.max_by("change_pct", size).alias("top_pct"))


def _headline() -> Column:
    plural = lambda c, one, many: F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, one).otherwise(many))
    return (
        F.when(F.col("alerts") > 0, plural("alerts", " alert fired", " alerts fired"))
        .when(F.col("breaches") > 0, plural("breaches", " risk threshold breached", " risk thresholds breached"))
        .when(F.col("top_pct").isNotNull(), F.concat(F.col("top_symbol"), F.format_string(" %+.1f%%", F.col("top_pct"))))
        .otherwise("no material movement"))


def build(lists: DataFrame, moved: DataFrame, fired: DataFrame, breaches: DataFrame) -> DataFrame:
    """One digest row per owner of a watch list, with everything in it."""
    return _counts(lists, moved, fired, breaches).withColumn("headline", _headline())


def build_complete(owners: DataFrame, lists: DataFrame, moved: DataFrame, fired: DataFrame, breaches: DataFrame, lines: DataFrame) -> DataFrame:
    """One digest row per owner, by the owner's choice of parts, with the portfolio line and notes on what is missing.

    owners(owner, portfolio, watchlist, alerts, risk): the parts are booleans, portfolio may be NULL.  lines(portfolio, line).
    """
    mine = owners.select("owner", "portfolio", *[F.col(c).alias(f"_{c}") for c in ("watchlist", "alerts", "risk")])
    out = mine.join(_counts(lists, moved, fired, breaches), "owner", "left").join(lines, "portfolio", "left")
    number = lambda c, part: F.when(F.col(part), F.coalesce(c, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    shown = out.select(
        "owner", "_watchlist", F.coalesce("symbols", F.lit(0).cast("long")).alias("symbols"), number(F.col("priced"), "_watchlist").alias("priced"),
        number(F.col("alerts"), "_alerts").alias("alerts"), number(F.col("breaches"), "_risk").alias("breaches"),
        F.when(F.col("_watchlist"), F.col("top_symbol")).alias("top_symbol"), F.when(F.col("_watchlist"), F.col("top_pct")).alias("top_pct"),
        F.coalesce("line", F.lit("")).alias("portfolio_line"))
    notes = F.concat_ws("; ", F.when(F.col("_watchlist") & (F.col("symbols") == 0), "nothing on the watch list"), F.when(F.col("portfolio_line") == "", "no holdings, watch list only"))
    return shown.withColumns({"headline": _headline(), "notes": notes}).drop("_watchlist")


def is_due(last_sent: Column, now: Column, period_days: Column) -> Column:
    """True when the period has passed, or the stamp is missing or unreadable."""
    last = F.try_to_timestamp(last_sent).cast("timestamp_ntz")
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")) >= period_days * 86_400_000_000, F.lit(True))


def portfolio_line(perf: DataFrame) -> DataFrame:
    """One line per portfolio: value, time-weighted return, excess."""
    text = F.concat_ws("; ", F.format_string("value %.0f", F.col("market_value")),
                       F.when(F.col("twr_pct").isNotNull(), F.format_string("time-weighted %+.2f%%", F.col("twr_pct"))),
                       F.when(F.col("excess_pct").isNotNull(), F.format_string("vs benchmark %+.2f%%", F.col("excess_pct"))))
    return perf.select("portfolio", text.alias("line"))


def _flag(test: Column, direction: str, severity: int, category: str, text: str) -> Column:
    return F.when(test, F.struct(F.lit(direction).alias("direction"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(text).alias("text")))


def flags(state: DataFrame) -> DataFrame:
    """All strengths and concerns of every symbol, in a fixed order (``pos``).

    state has the scorecard, quality, distress, risk and valuation columns, max_drawdown, macro_flag, rsi and the
    kinds of recent events (sma_kind, macd_kind, band_kind; NULL when none is recent).
    """
    c = F.col
    s, w = "strength", "concern"
    rows = [
        _flag(c("alignment") == "high", s, 3, "Fundamentals", "high scorecard alignment"),
        _flag(c("alignment") == "low", w, 3, "Fundamentals", "low scorecard alignment"),
    ]
    for m in P.SCORE_WEIGHTS:
        rows += [_flag(c(f"pass_{m}"), s, 1, "Fundamentals", f"{m} meets its benchmark"),
                 _flag(~c(f"pass_{m}"), w, 1, "Fundamentals", f"{m} misses its benchmark")]
    rows += [
        _flag(c("category").isin("Elite Quality", "High Quality"), s, 3, "Fundamentals", "high quality classification"),
        _flag(c("category").isin("Weak Quality", "Below Average"), w, 3, "Fundamentals", "weak quality classification"),
        _flag(c("altman_zone") == "safe", s, 3, "Risk", "distress score in the safe zone"),
        _flag(c("altman_zone") == "distress", w, 3, "Risk", "distress score in the distress zone"),
        _flag(c("risk_score") >= 75, s, 3, "Risk", "favourable composite risk score"),
        _flag(c("risk_score") < 50, w, 3, "Risk", "weak composite risk score"),
    ]
    for name, *_r in P.RISK_FACTORS:
        rows += [_flag(c(f"{name}_band") == "good", s, 2, "Risk", f"{name} is a strong factor"),
                 _flag(c(f"{name}_band") == "poor", w, 2, "Risk", f"{name} is a weak factor")]
    rows += [
        _flag(c("dcf_status").isin("Strong Buy", "Buy"), s, 2, "Valuation", "priced below intrinsic value"),
        _flag(c("dcf_status") == "Overvalued", w, 2, "Valuation", "priced above intrinsic value"),
        _flag(c("max_drawdown") <= -0.30, w, 2, "Risk", "deep drawdown"),
        _flag(c("max_drawdown") >= -0.10, s, 2, "Risk", "shallow drawdown"),
        _flag(c("macro_flag"), w, 1, "Macro", "high-fear market regime"),
        _flag(c("rsi") <= P.RSI_OVERSOLD, s, 2, "Technical", "oversold"),
        _flag(c("rsi") >= P.RSI_OVERBOUGHT, w, 2, "Technical", "overbought"),
        _flag(c("sma_kind") == "bullish", s, 1, "Technical", "recent bullish SMA crossover"),
        _flag(c("sma_kind") == "bearish", w, 1, "Technical", "recent bearish SMA crossover"),
        _flag(c("macd_kind") == "bullish", s, 1, "Technical", "recent bullish MACD crossover"),
        _flag(c("macd_kind") == "bearish", w, 1, "Technical", "recent bearish MACD crossover"),
        _flag(c("band_kind") == "lower", s, 1, "Technical", "recent break below the lower band"),
        _flag(c("band_kind") == "upper", w, 1, "Technical", "recent break above the upper band"),
    ]
    numbered = F.posexplode(F.array(*rows)).alias("pos", "f")
    return state.select("symbol", numbered).where(F.col("f").isNotNull()).select("symbol", F.col("pos").cast("long").alias("pos"), "f.*")


def top_flags(all_flags: DataFrame, n: int = 3) -> DataFrame:
    """Highest severity first, ties in list order, at most n per direction and never padded."""
    w = Window.partitionBy("symbol", "direction").orderBy(F.col("severity").desc(), "pos")
    return all_flags.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def verdict(score: Column, safety: Column, macro: Column) -> Column:
    strong = score >= P.STRONG_BUY_SCORE
    return (
        F.when(F.coalesce(macro, F.lit(False)), "STRONG AVOID").when(safety.isNull(), "NO VALUATION")
        .when(strong & (safety > P.STRONG_BUY_SAFETY), "STRONG BUY").when(strong, "HOLD (PREMIUM)")
        .when((score >= P.HOLD_SCORE) & (safety > P.HOLD_SAFETY), "HOLD / WATCHLIST").otherwise("AVOID"))


def fundamentals_view(analyzed: DataFrame) -> DataFrame:
    names = {
        "gross_margin_pct": 2, "operating_margin_pct": 2, "net_margin_pct": 2, "roa_pct": 2, "roe_pct": 2, "roic_pct": 2, "current_ratio_computed": 2,
        "quick_ratio_computed": 2, "interest_coverage": 2, "altman_z": 2, "pe_computed": 2, "pb_computed": 2, "ev_ebitda": 2, "fcf_yield_pct": 2,
    }
    return analyzed.select("symbol", "sector", "alignment", F.round("score_pct", 1).alias("score_pct"), *[F.round(k, d).alias(k) for k, d in names.items()])


MIN_VIEW_BARS, DEFAULT_DAYS, MAX_DAYS = 30, 365, 1825  # fixed values


def risk_view(bars: DataFrame, end: str, days: int = DEFAULT_DAYS) -> DataFrame:
    """Risk figures over the last ``days``; symbols with too few bars are refused with a reason."""
    if not 1 <= days <= MAX_DAYS:
        raise ValueError(f"days must be between 1 and {MAX_DAYS}")
    last = F.lit(end).cast("date")
    inside = bars.where((F.to_date("ts") >= F.date_sub(last, days)) & (F.to_date("ts") < last))
    m = rk.risk_metrics(inside, n=None)
    ok = F.col("bars") >= MIN_VIEW_BARS
    pct = lambda c: F.when(ok, F.round(F.col(c) * 100, 2))
    return m.select(
        "symbol", F.lit(days).cast("long").alias("window_days"), F.col("bars").alias("observations"), pct("ann_return").alias("annualized_return_pct"),
        pct("ann_vol").alias("annualized_volatility_pct"), F.when(ok, F.round("sharpe", 2)).alias("sharpe_ratio"), F.when(ok, F.round("sortino", 2)).alias("sortino_ratio"),
        pct("hist_var").alias("historical_var_pct"), pct("expected_shortfall").alias("expected_shortfall_pct"), pct("max_drawdown").alias("max_drawdown_pct"),
        F.when(~ok, F.format_string("only %d bars: too few to annualize from", F.col("bars"))).alias("refusal"))
