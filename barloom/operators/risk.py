"""Return, tail, drawdown and composite risk metrics, one row per symbol.

Threshold-then-mean statistics (expected shortfall, recovery length) use whole-series
windows on the same key, so a complete risk table costs one shuffle of the bars.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.score import linear, names_where, weighted
from barloom.functions.series import KEY, bands, over_time, prev, running, sdiv, trailing, whole

YEAR = float(P.TRADING_DAYS)


def log_returns(df: DataFrame, price: str = "close", key: Sequence[str] = KEY) -> DataFrame:
    return df.withColumn("ret", F.log(sdiv(F.col(price), prev(F.col(price), key=key))))


def simple_returns(df: DataFrame, price: str = "close", key: Sequence[str] = KEY) -> DataFrame:
    return df.withColumn("r", sdiv(F.col(price), prev(F.col(price), key=key)) - 1)


def rolling_vol(n: int, key: Sequence[str] = KEY) -> Column:
    w = trailing(n, key)
    return F.when(F.count("ret").over(w) == n, F.stddev_samp("ret").over(w)) * YEAR**0.5


def lookback(df: DataFrame, n: int | None, key: Sequence[str] = KEY) -> DataFrame:
    """Marks the newest n returns in ``recent`` (all of them when n is None)."""
    if n is None:
        return df.withColumn("recent", F.col("ret"))
    newest = Window.partitionBy(*key).orderBy(F.col("ts").desc())
    return df.withColumn("recent", F.when(F.row_number().over(newest) <= n, F.col("ret")))


def performance_columns(rf: float = P.RISK_FREE, target: float = 0.0) -> dict[str, Column]:
    """Aggregates over ``ret``; everything is NULL under two returns."""
    enough = F.count("ret") >= 2
    ann_ret, ann_vol = F.avg("ret") * YEAR, F.stddev_samp("ret") * YEAR**0.5
    down = F.sqrt(F.avg(F.pow(F.when(F.col("ret").isNotNull(), F.least(F.col("ret") - target, F.lit(0.0))), 2.0)))
    return {
        "n_returns": F.count("ret"),
        "ann_return": F.when(enough, ann_ret),
        "ann_vol": F.when(enough, ann_vol),
        "sharpe": F.when(enough, sdiv(ann_ret - rf, ann_vol)),
        "downside_dev": F.when(enough, down * YEAR**0.5),
        "sortino": F.when(enough, sdiv(ann_ret - rf, down * YEAR**0.5)),
    }


def performance(df: DataFrame, key: Sequence[str] = KEY, rf: float = P.RISK_FREE) -> DataFrame:
    return log_returns(df, key=key).groupBy(*key).agg(*[c.alias(n) for n, c in performance_columns(rf).items()])


def sharpe_band(v: Column) -> Column:
    return bands(v, [("<", 0, "poor"), ("<", 1, "sub-optimal"), ("<", 2, "good"), ("<", 3, "very good")], "exceptional")


def calmar_band(v: Column) -> Column:
    return bands(v, [("<", 0, "poor"), ("<", 1, "sub-optimal"), ("<", 3, "good"), ("<", 5, "very good")], "excellent")


def with_tail(df: DataFrame, conf: float = P.VAR_CONFIDENCE, key: Sequence[str] = KEY) -> DataFrame:
    """Adds the empirical threshold of ``recent`` to every row of its series."""
    return df.withColumn("_cut", F.percentile("recent", F.lit(1.0 - conf)).over(whole(key)))


def tail_columns(conf: float = P.VAR_CONFIDENCE, min_obs: int = P.VAR_MIN_OBS) -> dict[str, Column]:
    z = NormalDist().inv_cdf(1.0 - conf)
    enough = F.count("recent") >= min_obs
    return {
        "observations": F.count("recent"),
        "hist_var": F.when(enough, F.first("_cut")),
        "param_var": F.when(enough, F.avg("recent") + z * F.stddev_samp("recent")),
        "expected_shortfall": F.when(enough, F.avg(F.when(F.col("recent") <= F.col("_cut"), F.col("recent")))),
    }


def tail_risk(df: DataFrame, conf: float = P.VAR_CONFIDENCE, n: int | None = P.VAR_LOOKBACK,
              key: Sequence[str] = KEY) -> DataFrame:
    marked = with_tail(lookback(log_returns(df, key=key), n, key), conf, key)
    return marked.groupBy(*key).agg(*[c.alias(name) for name, c in tail_columns(conf).items()])


def tail_sentence(var: Column, es: Column, conf: float = P.VAR_CONFIDENCE) -> Column:
    text = F.format_string(
        f"Beyond the {conf:.0%}% VaR cutoff of %.2f%% the average loss is %.2f%%, %.2f points worse",
        var * 100, es * 100, F.abs(es - var) * 100)
    return F.when(var.isNotNull() & es.isNotNull(), text)


def with_drawdown(df: DataFrame, price: str = "close", key: Sequence[str] = KEY) -> DataFrame:
    """Adds ``peak`` (running maximum) and ``drawdown``; NULL prices must be filtered first."""
    step = df.withColumn("peak", F.max(price).over(running(key)))
    return step.withColumn("drawdown", sdiv(F.col(price) - F.col("peak"), F.col("peak")))


def with_trough(df: DataFrame, price: str = "close", key: Sequence[str] = KEY) -> DataFrame:
    """Adds the first deepest point of every series and the first later bar back at its peak."""
    deepest = F.min(F.struct("drawdown", "ts", "peak", F.col(price).alias("low"))).over(whole(key))
    step = df.withColumn("_t", deepest)
    back = F.when((F.col("ts") >= F.col("_t.ts")) & (F.col(price) >= F.col("_t.peak")), F.col("ts"))
    return step.withColumn("_back", F.min(back).over(whole(key)))


def trough_columns(price: str = "close") -> dict[str, Column]:
    t = F.first("_t")
    at_peak = (F.col("ts") <= F.col("_t.ts")) & (F.col(price) == F.col("_t.peak"))
    between = (F.col("ts") > F.col("_t.ts")) & (F.col("ts") <= F.col("_back"))
    return {
        "max_drawdown": t["drawdown"],
        "peak_ts": F.max(F.when(at_peak, F.col("ts"))),
        "peak_price": t["peak"],
        "trough_ts": t["ts"],
        "trough_price": t["low"],
        "recovered": F.first("_back").isNotNull(),
        "recovery_ts": F.first("_back"),
        "recovery_days": F.when(F.first("_back").isNotNull(), F.count_if(between)),
    }


def max_drawdown(df: DataFrame, price: str = "close", key: Sequence[str] = KEY) -> DataFrame:
    valid = df.where(F.col(price).isNotNull())
    marked = with_trough(with_drawdown(valid, price, key), price, key)
    return marked.groupBy(*key).agg(*[c.alias(n) for n, c in trough_columns(price).items()])


def risk_metrics(df: DataFrame, conf: float = P.VAR_CONFIDENCE, n: int | None = P.VAR_LOOKBACK,
                 rf: float = P.RISK_FREE, vol_window: int = P.VOL_WINDOW, key: Sequence[str] = KEY) -> DataFrame:
    """Volatility, Sharpe, Sortino, VaR, shortfall, drawdown and Calmar of every series in one pass."""
    base = df.select(*key, "ts", "close").where(F.col("close").isNotNull())
    marked = log_returns(base, key=key).withColumn("_vol", rolling_vol(vol_window, key))
    marked = with_trough(with_drawdown(with_tail(lookback(marked, n, key), conf, key), key=key), key=key)
    cols = {
        "bars": F.count(F.lit(1)),
        **performance_columns(rf), **tail_columns(conf), **trough_columns(),
        "rolling_vol": F.max_by("_vol", F.when(F.col("_vol").isNotNull(), F.col("ts"))),
        "last_close": F.max_by("close", "ts"),
    }
    out = marked.groupBy(*key).agg(*[c.alias(name) for name, c in cols.items()])
    return out.withColumn("calmar", sdiv(F.col("ann_return"), F.abs(F.col("max_drawdown"))))


def hurst(df: DataFrame, min_window: int = 10, sizes: int = 20, key: Sequence[str] = KEY) -> DataFrame:
    """Rescaled-range exponent; sizes x rows is a constant blow-up, every chunk is its own group."""
    w = over_time(key)
    rets = log_returns(df, key=key).where(F.col("ret").isNotNull())
    rets = rets.select(*key, "ts", "ret", (F.row_number().over(w) - 1).alias("i"), F.count("ret").over(whole(key)).alias("n"))
    top = F.floor(F.col("n") / 2)
    exponent = lambda k: 1 + k * (F.log10(top.cast("double")) - 1) / (sizes - 1)
    # the two ends are exact integers; only the inner points come from the logarithmic grid
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(sizes - 1)),
        lambda k: F.when(k == 0, F.lit(min_window)).when(k == sizes - 1, top)
        .otherwise(F.floor(F.pow(F.lit(float(min_window)), exponent(k)))),
    )
    chunks = (
        rets.where(top >= min_window)
        .withColumn("size", F.explode(F.array_distinct(grid)))
        .withColumn("chunk", F.floor(F.col("i") / F.col("size")))
        .where(F.col("chunk") < F.floor(F.col("n") / F.col("size")))
    )
    part = [*key, "size", "chunk"]
    dev = F.col("ret") - F.avg("ret").over(Window.partitionBy(*part))
    walked = chunks.withColumn("dev", dev).withColumn(
        "walk", F.sum("dev").over(Window.partitionBy(*part).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    rs = (
        walked.groupBy(*part).agg((F.max("walk") - F.min("walk")).alias("r"), F.stddev_pop("ret").alias("s"))
        .where(F.col("s") > 0)
        .groupBy(*key, "size").agg(F.avg(F.col("r") / F.col("s")).alias("rs"))
    )
    fit = rs.groupBy(*key).agg(
        F.when(F.count(F.lit(1)) >= 2, F.regr_slope(F.log("rs"), F.log("size"))).alias("hurst"),
        F.count(F.lit(1)).alias("sizes"))
    return df.select(*key).distinct().join(fit, list(key), "left").withColumn("regime", hurst_regime(F.col("hurst")))


def hurst_regime(v: Column) -> Column:
    return bands(v, [("<", P.HURST_REVERTING, "mean-reverting"), (">", P.HURST_TRENDING, "trending")], "random walk")


def return_histogram(df: DataFrame, bins: int = 40, n: int = P.VAR_LOOKBACK, key: Sequence[str] = KEY) -> DataFrame:
    """Counts of recent returns in equal-width bins between their extremes, with the tail markers."""
    marked = with_tail(lookback(log_returns(df, key=key), n, key), key=key).where(F.col("recent").isNotNull())
    tail = F.avg(F.when(F.col("recent") <= F.col("_cut"), F.col("recent"))).over(whole(key))
    low, high = F.min("recent").over(whole(key)), F.max("recent").over(whole(key))
    marked = marked.withColumns({"low": low, "high": high, "es": tail})
    spread = F.col("high") - F.col("low")
    slot = F.least(F.floor(sdiv(F.col("recent") - F.col("low"), spread) * bins), F.lit(bins - 1))
    return marked.groupBy(*key, F.coalesce(slot, F.lit(0)).cast("long").alias("bin")).agg(
        (F.first("low") + F.min(spread) / bins * F.first(F.coalesce(slot, F.lit(0)))).alias("bin_low"),
        F.count(F.lit(1)).alias("n"), F.first("_cut").alias("hist_var"), F.first("es").alias("expected_shortfall"))


def macro_flag(fear: DataFrame, level: float = P.FEAR_HIGH) -> DataFrame:
    """One row: is the last close of the fear index above the level?"""
    last = fear.agg(F.coalesce(F.max_by("close", "ts"), F.lit(P.FEAR_DEFAULT)).alias("fear"))
    return last.withColumn("macro_flag", F.col("fear") > level)


def position_sizing(df: DataFrame, macro: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Halved Kelly fraction in percent, halved again under the macro flag."""
    r = F.col("r")
    stats = simple_returns(df, key=key).groupBy(*key).agg(
        F.count("r").alias("n"),
        F.count_if(r > 0).alias("wins"), F.avg(F.when(r > 0, r)).alias("avg_win"),
        F.count_if(r < 0).alias("losses"), F.avg(F.when(r < 0, r)).alias("avg_loss"),
    ).where((F.col("n") > 0) & (F.col("losses") > 0))
    stats = stats.withColumns({
        "win_prob": F.col("wins") / F.col("n"),
        "payoff": F.coalesce(sdiv(F.col("avg_win"), F.abs(F.col("avg_loss"))), F.lit(0.0)),
    })
    p, b = F.col("win_prob"), F.col("payoff")
    f = F.greatest(F.when(b > 0, p - sdiv(1 - p, b)).otherwise(0.0), F.lit(0.0))
    shrink = F.when(F.col("macro_flag"), P.KELLY_MACRO).otherwise(1.0)
    return stats.crossJoin(F.broadcast(macro)).select(
        *key, "n", "win_prob", "payoff", (f / P.KELLY_HALF * 100 / shrink).alias("allocation_pct"))


def risk_grade(score: Column) -> Column:
    return bands(score, [(">=", 75, "low risk"), (">=", 50, "moderate risk"), (">=", 30, "elevated risk")], "high risk")


def factor_band(score: Column) -> Column:
    return F.coalesce(bands(score, [(">=", 70, "good"), (">=", 40, "fair")], "poor"), F.lit("unknown"))


def risk_score(metrics: DataFrame, safe_zone: Column | float = P.ALTMAN_SAFE) -> DataFrame:
    """Composite score from the eight factor columns; missing factors leave the average."""
    parts, missing, bands_of = [], [], {}
    for name, best, worst, weight in P.RISK_FACTORS:
        full_at = safe_zone if name == "altman_z" else best
        score = linear(F.col(name), worst, full_at)
        parts.append((score, weight))
        missing.append((F.col(name).isNull(), name))
        bands_of[f"{name}_band"] = factor_band(score)
    value = F.round(weighted(parts, empty=0.0), 1)
    present = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n, *_ in P.RISK_FACTORS), F.lit(0))
    return metrics.withColumns({
        "risk_score": value, "risk_grade": risk_grade(value), "factors": present.cast("long"),
        "excluded": names_where(missing), **bands_of,
    })
