"""Technical indicators: every function adds columns to a bar table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import bands, full, over_time, prev, running, sdiv, whole
from barloom.functions.smoothing import Smooth, smooth, span, wilder

def sma(df: DataFrame, periods: Sequence[int], x: str = "close") -> DataFrame:
    return df.withColumns({f"sma_{n}": full(F.avg, F.col(x), n) for n in periods})


def bollinger(df: DataFrame, n: int = P.SMA_DEFAULT, k: float = P.BOLLINGER_STD) -> DataFrame:
    mean, sd = full(F.avg, F.col("close"), n), full(F.stddev_samp, F.col("close"), n)
    return df.withColumns({"bb_middle": mean, "bb_upper": mean + k * sd, "bb_lower": mean - k * sd})


def zscore(df: DataFrame, n: int = P.SMA_DEFAULT) -> DataFrame:
    mean, sd = full(F.avg, F.col("close"), n), full(F.stddev_samp, F.col("close"), n)
    return df.withColumn("zscore", sdiv(F.col("close") - mean, sd))


def rsi(df: DataFrame, n: int = P.RSI_PERIOD) -> DataFrame:
    keep = df.columns
    step = df.withColumn("_chg", F.col("close") - prev(F.col("close")))
    moved = F.col("_chg").isNotNull()
    step = step.withColumns({
        "_gain": F.when(moved, F.greatest(F.col("_chg"), F.lit(0.0))),
        "_loss": F.when(moved, F.greatest(-F.col("_chg"), F.lit(0.0))),
    })
    step = smooth(step, [
        Smooth("_ag", "_gain", wilder(n), min_count=n),
        Smooth("_al", "_loss", wilder(n), min_count=n, like="_gain"),
    ])
    ag, al = F.col("_ag"), F.col("_al")
    value = (
        F.when((ag == 0) & (al == 0), F.lit(50.0))
        .when(al == 0, F.lit(100.0))
        .otherwise(100 - sdiv(F.lit(100.0), 1 + sdiv(ag, al)))
    )
    return step.withColumn("rsi", F.when(ag.isNotNull(), value)).select(*keep, "rsi")


def rsi_zone(value: Column) -> Column:
    return bands(value, [(">=", P.RSI_OVERBOUGHT, "overbought"), ("<=", P.RSI_OVERSOLD, "oversold")], "neutral")


def macd(df: DataFrame, fast: int = P.MACD_FAST, slow: int = P.MACD_SLOW, signal: int = P.MACD_SIGNAL) -> DataFrame:
    keep = df.columns
    step = smooth(df, [Smooth("_f", "close", span(fast), seed=fast), Smooth("_s", "close", span(slow), seed=slow)])
    step = step.withColumn("macd_line", F.col("_f") - F.col("_s"))
    step = smooth(step, [Smooth("macd_signal", "macd_line", span(signal), seed=signal)])
    step = step.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))
    return step.select(*keep, "macd_line", "macd_signal", "macd_hist")


def true_range() -> Column:
    """Skips NULL, so the first bar is high - low."""
    before = prev(F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(df: DataFrame, n: int = P.ATR_PERIOD) -> DataFrame:
    keep = df.columns
    step = df.withColumn("true_range", true_range())
    return smooth(step, [Smooth("atr", "true_range", wilder(n), seed=n)]).select(*keep, "true_range", "atr")


def stop_loss(price: Column, atr_value: Column, k: float = P.ATR_STOP_MULTIPLIER) -> Column:
    return price - k * atr_value


def stochastic(df: DataFrame, k: int = P.STOCH_K, d: int = P.STOCH_D, smooth_k: int = P.STOCH_SMOOTH) -> DataFrame:
    keep = df.columns
    low, high = full(F.min, F.col("low"), k), full(F.max, F.col("high"), k)
    step = df.withColumn("_raw", sdiv(100 * (F.col("close") - low), high - low))
    step = step.withColumn("stoch_k", full(F.avg, F.col("_raw"), smooth_k) if smooth_k > 1 else F.col("_raw"))
    return step.withColumn("stoch_d", full(F.avg, F.col("stoch_k"), d)).select(*keep, "stoch_k", "stoch_d")


def level_zone(value: Column, high: float, low: float) -> Column:
    return bands(value, [(">=", high, "overbought"), ("<=", low, "oversold")], "neutral")


def anchored_vwap(df: DataFrame, anchor: Column) -> DataFrame:
    """``anchor`` is a timestamp column or literal; earlier bars stay NULL."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    inside = F.col("ts") >= anchor
    pv = F.sum(F.when(inside, typical * F.col("volume"))).over(running())
    v = F.sum(F.when(inside, F.col("volume"))).over(running())
    return df.withColumn("vwap", sdiv(pv, v))


def adx(df: DataFrame, n: int = P.ADX_PERIOD) -> DataFrame:
    keep = df.columns
    up = F.col("high") - prev(F.col("high"))
    down = prev(F.col("low")) - F.col("low")
    step = df.withColumns({"_up": up, "_down": down, "_tr": F.when(prev(F.col("close")).isNotNull(), true_range())})
    u, d = F.col("_up"), F.col("_down")
    step = step.withColumns({
        "_pdm": F.when(u.isNotNull(), F.when((u > d) & (u > 0), u).otherwise(0.0)),
        "_mdm": F.when(u.isNotNull(), F.when((d > u) & (d > 0), d).otherwise(0.0)),
    })
    step = smooth(step, [
        Smooth("_atr", "_tr", wilder(n), seed=n, positional=True),
        Smooth("_p", "_pdm", wilder(n)),
        Smooth("_m", "_mdm", wilder(n), like="_pdm"),
    ])
    k = sdiv(F.lit(100.0), F.col("_atr"))
    step = step.withColumns({"plus_di": k * F.col("_p"), "minus_di": k * F.col("_m")})
    p, m = F.col("plus_di"), F.col("minus_di")
    step = step.withColumn("_dx", sdiv(100 * F.abs(p - m), p + m))
    return smooth(step, [Smooth("adx", "_dx", wilder(n))]).select(*keep, "plus_di", "minus_di", "adx")


def midprice(n: int) -> Column:
    return (full(F.max, F.col("high"), n) + full(F.min, F.col("low"), n)) / 2


def ichimoku(df: DataFrame, tenkan: int = P.TENKAN, kijun: int = P.KIJUN, senkou: int = P.SENKOU_B) -> DataFrame:
    keep = df.columns
    step = df.withColumns({"tenkan": midprice(tenkan), "kijun": midprice(kijun), "_b": midprice(senkou)})
    step = step.withColumn("_a", (F.col("tenkan") + F.col("kijun")) / 2)
    return step.withColumns({
        "senkou_a": F.lag("_a", kijun - 1).over(over_time()),
        "senkou_b": F.lag("_b", kijun - 1).over(over_time()),
        "chikou": F.lead("close", kijun - 1).over(over_time()),
    }).select(*keep, "tenkan", "kijun", "senkou_a", "senkou_b", "chikou")


def ichimoku_forward(df: DataFrame, tenkan: int = P.TENKAN, kijun: int = P.KIJUN,
                     senkou: int = P.SENKOU_B) -> DataFrame:
    """The cloud ahead of the last bar: (symbol, ts, step, senkou_a, senkou_b) on coming business days."""
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    spans = df.select(
        "symbol", "ts", ((midprice(tenkan) + midprice(kijun)) / 2).alias("a"), midprice(senkou).alias("b"),
        F.row_number().over(newest).alias("back"), F.max("ts").over(whole()).alias("last_ts"),
    ).where(F.col("back") <= kijun)
    # row "back" is dated on business day kijun - back + 1 and shows the span of the next bar
    shown = spans.withColumns({
        "step": (kijun - F.col("back") + 1).cast("long"),
        "senkou_a": F.lead("a").over(over_time()), "senkou_b": F.lead("b").over(over_time()),
    })
    days = F.expr(f"sequence(to_date(last_ts) + 1, to_date(last_ts) + {kijun // 5 * 7 + 14})")
    business = F.filter(days, lambda d: F.weekday(d) < 5)
    return shown.select(
        "symbol", F.element_at(business, F.col("step").cast("int")).cast("timestamp_ntz").alias("ts"), "step",
        "senkou_a", "senkou_b",
    )


def obv(df: DataFrame) -> DataFrame:
    change = F.col("close") - prev(F.col("close"))
    step = df.withColumn("_flow", F.signum(change) * F.col("volume"))
    return step.withColumn("obv", F.sum("_flow").over(running())).drop("_flow")


def relative_return(df: DataFrame, bench: DataFrame) -> DataFrame:
    """Cumulative return of the symbol and of the benchmark since the symbol's first common bar, in percent."""
    step = df.join(bench, "ts")
    first = lambda c: F.first(c).over(running())
    step = step.withColumns({
        "cum_pct": (sdiv(F.col("close"), first("close")) - 1) * 100,
        "bench_pct": (sdiv(F.col("bench"), first("bench")) - 1) * 100,
    })
    return step.withColumn("alpha_pct", F.col("cum_pct") - F.col("bench_pct"))
