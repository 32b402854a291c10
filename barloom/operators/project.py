"""Resampled price paths and stress scenarios, one row per (symbol, path, day).

Draws come from a hash of (symbol, path, step), so a lost task redraws the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import bands, over_time, running, sdiv
from barloom.operators import fundamentals as fa
from barloom.operators import risk as rk
from barloom.operators.portfolio import uniform

PATH = ("symbol", "sim")


def _spread(start: DataFrame, sims: int) -> DataFrame:
    """One row per path, hashed over the cluster before the days are unfolded."""
    return start.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long")))).repartition(*PATH)


def _days(n: int) -> Column:
    return F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")))


def normal(*parts: Column) -> Column:
    u1, u2 = uniform(*parts, F.lit("a")), uniform(*parts, F.lit("b"))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def gbm_steps(bars: DataFrame, sims: int = P.SIMULATIONS, days: int = P.FORECAST_DAYS) -> DataFrame:
    """(symbol, sim, day, start, step): log growth of every simulated day; short histories are left out."""
    stats = rk.simple_returns(bars.select("symbol", "ts", "close")).groupBy("symbol").agg(
        F.max_by("close", "ts").alias("start"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count("r").alias("n"))
    paths = _spread(stats.where(F.col("n") > P.MIN_HISTORY), sims).withColumn("day", _days(days))
    drift = F.col("m") - 0.5 * F.col("s") * F.col("s")
    return paths.select(*PATH, "day", "start", (drift + F.col("s") * normal(F.col("symbol"), F.col("sim"), F.col("day"))).alias("step"))


def bootstrap_steps(bars: DataFrame, sims: int = P.SIMULATIONS, days: int = P.FORECAST_DAYS, block: int = P.BLOCK_DAYS) -> DataFrame:
    """Steps made of blocks of consecutive historical log returns drawn with replacement."""
    rets = rk.log_returns(bars.select("symbol", "ts", "close"))
    start = rets.groupBy("symbol").agg(F.max_by("close", "ts").alias("start"), F.count("ret").alias("n"))
    indexed = rets.where(F.col("ret").isNotNull()).select(
        "symbol", (F.row_number().over(over_time()) - 1).cast("long").alias("i"), F.col("ret").alias("step"))
    blocks = -(-days // block)
    paths = _spread(start.where(F.col("n") > P.MIN_HISTORY), sims).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    # one draw per block, then its consecutive days
    first = F.floor(uniform(F.col("symbol"), F.col("sim"), F.col("_b")) * (F.col("n") - block + 1)).cast("long")
    inside = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(block - 1).cast("long")))
    drawn = paths.withColumn("_first", first).withColumn("_k", inside).withColumns({
        "i": F.col("_first") + F.col("_k"), "day": F.col("_b") * block + F.col("_k") + 1}).where(F.col("day") <= days)
    return drawn.join(indexed, ["symbol", "i"]).select(*PATH, "day", "start", "step")


def paths(steps: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PATH).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*PATH, "day", (F.col("start") * F.exp(F.sum("step").over(w))).alias("price"))


def terminal_stats(steps: DataFrame) -> DataFrame:
    """Share of paths ending above the start, the 10/50/90 percentiles and the bias label."""
    ends = steps.groupBy(*PATH).agg(F.first("start").alias("start"), (F.first("start") * F.exp(F.sum("step"))).alias("end"))
    out = ends.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sims"), (F.avg((F.col("end") > F.col("start")).cast("double")) * 100).alias("pct_above"),
        F.percentile("end", F.lit(0.1)).alias("p10"), F.percentile("end", F.lit(0.5)).alias("p50"), F.percentile("end", F.lit(0.9)).alias("p90"))
    return out.withColumns({
        "bias": bands(F.col("pct_above"), [(">=", P.UPSIDE_PCT, "upside"), ("<=", P.DOWNSIDE_PCT, "downside")], "balanced"),
        "seed": F.crc32("symbol")})


@dataclass(frozen=True)
class Scenario:
    name: str
    kind: str
    growth_delta: float = 0.0
    discount_delta: float = 0.0
    vol_mult: float = 1.0
    mean_shift: float = 0.0
    dividend_cut_pct: float = 0.0


# --- fixed values: scenario presets ---
PRESETS = (
    Scenario("Recession", "recession", -0.06, 0.02, 1.6, -0.0015),
    Scenario("Sector Multiple Compression", "sector_shift", 0.0, 0.025, 1.2),
    Scenario("Dividend Cut", "dividend_cut", 0.0, 0.0, 1.0, 0.0, 50.0),
)
INVESTMENT = 10_000.0


def with_scenarios(df: DataFrame, scenarios: Sequence[Scenario] = PRESETS) -> DataFrame:
    """Every row once per scenario (an explode of a literal list)."""
    cells = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in vars(s).items()]) for s in scenarios]))
    return df.withColumn("_s", cells).select(*df.columns, F.col("_s.name").alias("scenario"), *[F.col(f"_s.{k}").alias(f"sc_{k}") for k in vars(scenarios[0]) if k != "name"])


def dcf_scenarios(analyzed: DataFrame, growth: float, scenarios: Sequence[Scenario] = PRESETS) -> DataFrame:
    """Valuation at the shocked rates, refused when the shocked rate meets terminal growth."""
    df = with_scenarios(analyzed, scenarios)
    g, r = F.lit(growth) + F.col("sc_growth_delta"), F.col("wacc") + F.col("sc_discount_delta")
    gate = F.coalesce(fa.dcf_gate(), F.when(r <= P.TERMINAL_GROWTH, "shocked discount rate at or below terminal growth"))
    df = df.withColumn("reason", gate)
    ok = F.col("reason").isNull()
    df = df.withColumns({
        "base_intrinsic": F.when(ok, fa.intrinsic_price(F.lit(growth), F.col("wacc"))),
        "shocked_intrinsic": F.when(ok, fa.intrinsic_price(g, r))})
    change = sdiv(F.col("shocked_intrinsic") - F.col("base_intrinsic"), F.col("base_intrinsic")) * 100
    return df.select("symbol", "scenario", "reason", "base_intrinsic", "shocked_intrinsic", change.alias("change_pct"))


def shocked_prices(bars: DataFrame, scenarios: Sequence[Scenario] = PRESETS) -> DataFrame:
    """History with every log return scaled and shifted, compounded from the untouched first price."""
    rets = rk.log_returns(bars.select("symbol", "ts", "close"))
    df = with_scenarios(rets, scenarios)
    key = ("symbol", "scenario")
    shocked = F.coalesce(F.col("ret") * F.col("sc_vol_mult") + F.col("sc_mean_shift"), F.lit(0.0))
    df = df.withColumn("_r", shocked)
    first = F.first("close").over(running(key))
    return df.select(*key, "ts", (first * F.exp(F.sum("_r").over(running(key)))).alias("close"))


def risk_scenarios(bars: DataFrame, scenarios: Sequence[Scenario] = PRESETS) -> DataFrame:
    """VaR, shortfall, Sharpe and drawdown before and after each shock."""
    names = ("hist_var", "expected_shortfall", "sharpe", "max_drawdown")
    base = rk.risk_metrics(bars).select("symbol", *[F.col(n).alias(f"base_{n}") for n in names])
    after = rk.risk_metrics(shocked_prices(bars, scenarios), key=("symbol", "scenario")).select(
        "symbol", "scenario", *[F.col(n).alias(f"shocked_{n}") for n in names])
    return after.join(base, "symbol")


def dividend_cut(profile: DataFrame, cut_pct: float) -> DataFrame:
    rate, price = F.col("dividend_rate"), F.nullif("quote_price", F.lit(0.0))
    detail = F.when(F.coalesce(rate, F.lit(0.0)) <= 0, "no regular dividend").when(F.coalesce(price, F.lit(0.0)) <= 0, "price unavailable")
    ok = detail.isNull()
    after = rate * (1 - cut_pct / 100)
    return profile.select(
        "symbol", ok.alias("applicable"), detail.alias("detail"), F.when(ok, after).alias("shocked_dividend"),
        F.when(ok, rate - after).alias("lost_income"), F.when(ok, sdiv(rate, price) * 100).alias("yield_pct"),
        F.when(ok, sdiv(after, price) * 100).alias("shocked_yield_pct"))


def run_scenarios(analyzed: DataFrame, profile: DataFrame, bars: DataFrame, growth: float, scenarios: Sequence[Scenario] = PRESETS,
                  amount: float = INVESTMENT) -> DataFrame:
    """All impacts of every scenario on every symbol, with the implied change of an invested amount."""
    out = dcf_scenarios(analyzed, growth, scenarios).join(risk_scenarios(bars, scenarios), ["symbol", "scenario"], "left")
    cut = next((s for s in scenarios if s.kind == "dividend_cut"), None)
    if cut is not None:
        lost = dividend_cut(profile, cut.dividend_cut_pct).where("applicable").select("symbol", F.lit(cut.name).alias("scenario"), "lost_income", "shocked_yield_pct")
        out = out.join(lost, ["symbol", "scenario"], "left")
    return out.withColumn("implied_change", amount * F.col("change_pct") / 100)
