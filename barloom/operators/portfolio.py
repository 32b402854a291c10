"""Several assets at once: alignment, correlation, beta, attribution, diversification, allocation.

members(basket, symbol[, weight]) lists what belongs together.  Portfolio variance is taken as the
variance of the weighted return series, which equals w'Cov w and needs no pair of assets; pairs are
built only where the pair matrix is the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import sdiv, with_previous
from barloom.operators.risk import YEAR, log_returns, lookback


def aligned_returns(bars: DataFrame, members: DataFrame, n: int | None = None) -> DataFrame:
    """(basket, symbol, ts, ret) on the dates where every usable member has a return."""
    rets = lookback(log_returns(bars.select("symbol", "ts", "close")), n)
    rets = rets.where(F.col("recent").isNotNull()).select("symbol", "ts", F.col("recent").alias("ret"))
    joined = rets.join(members.select("basket", "symbol"), "symbol")
    usable = joined.select("basket", "symbol").distinct().groupBy("basket").agg(F.count(F.lit(1)).alias("_size"))
    # a count and a join: both combine before the shuffle or split a large basket, which a window cannot
    whole = joined.groupBy("basket", "ts").agg(F.count(F.lit(1)).alias("_here")).join(usable, "basket")
    whole = whole.where((F.col("_here") == F.col("_size")) & (F.col("_size") >= 2)).select("basket", "ts")
    return joined.join(whole, ["basket", "ts"]).select("basket", "symbol", "ts", "ret")


def alignment_report(aligned: DataFrame, bars: DataFrame, members: DataFrame) -> DataFrame:
    """Per basket member: included or why not, and whether the basket has enough common dates."""
    have = bars.groupBy("symbol").agg(F.count("close").alias("_bars"))
    per_basket = aligned.groupBy("basket").agg(F.count_distinct("ts").alias("observations"))
    usable = F.count_if(F.col("_bars") >= 2).over(Window.partitionBy("basket"))
    out = (
        members.select("basket", "symbol").join(have, "symbol", "left").join(per_basket, "basket", "left")
        .withColumns({
            "observations": F.coalesce("observations", F.lit(0)).cast("long"),
            "reason": F.when(F.col("_bars").isNull(), "no bars")
            .when(F.col("_bars") < 2, "too few bars for a return")
            .when(F.col("observations").isNull(), "no common dates in the basket"),
            "_usable": usable,
        })
    )
    return out.select("basket", "symbol", "observations", "reason",
                      ((F.col("observations") >= P.ALIGN_MIN_OBS) & (F.col("_usable") >= 2)).alias("sufficient"))


def pair_statistics(aligned: DataFrame) -> DataFrame:
    """Correlation and annualised covariance of every pair of a basket (the pair matrix is the result)."""
    a = aligned.select("basket", "ts", F.col("symbol").alias("a"), F.col("ret").alias("x"))
    b = aligned.select("basket", "ts", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    return a.join(b, ["basket", "ts"]).groupBy("basket", "a", "b").agg(
        F.corr("x", "y").alias("corr"), (F.covar_samp("x", "y") * YEAR).alias("cov"), F.count(F.lit(1)).alias("n"))


def capm_beta(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Slope of the asset's on the benchmark's log returns; NULL under 60 common dates or a flat benchmark."""
    asset = log_returns(bars.select("symbol", "ts", "close")).select("symbol", "ts", "ret")
    market = with_previous(bench.select("ts", "bench"), "bench", "_before")
    market = market.select("ts", F.when((F.col("bench") > 0) & (F.col("_before") > 0), F.log(F.col("bench") / F.col("_before"))).alias("m"))
    both = asset.join(market, "ts").where(F.col("ret").isNotNull() & F.col("m").isNotNull())
    fit = both.groupBy("symbol").agg(
        F.regr_slope("ret", "m").alias("beta"), F.pow(F.corr("ret", "m"), 2.0).alias("r_squared"),
        F.count(F.lit(1)).alias("n"))
    ok = F.col("n") >= P.BETA_MIN_OBS
    return fit.select("symbol", F.when(ok, F.col("beta")).alias("beta"),
                      F.when(ok, F.col("r_squared")).alias("r_squared"), "n")


def attribution(asset_pct: Column, bench_pct: Column, beta: Column, days: Column,
                rf: float = P.RISK_FREE) -> dict[str, Column]:
    years = F.when(days > 0, days / 365.25).otherwise(0.0)
    rf_pct = (F.pow(F.lit(1 + rf), years) - 1) * 100
    total = asset_pct - rf_pct
    systematic = beta * (bench_pct - rf_pct)
    return {"risk_free_pct": rf_pct, "total_excess_pct": total, "systematic_pct": systematic,
            "selection_pct": total - systematic}


def equal_weights(members: DataFrame) -> DataFrame:
    return members.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("basket")))


def diversification(aligned: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Portfolio volatility against the weighted mean of its members' volatilities."""
    names = aligned.select("basket", "symbol").distinct()
    raw = equal_weights(names) if weights is None else names.join(weights, ["basket", "symbol"], "left").fillna(0.0, ["weight"])
    total = F.sum("weight").over(Window.partitionBy("basket"))
    w = raw.withColumn("_t", total).where(F.col("_t") > 0).select("basket", "symbol", (F.col("weight") / F.col("_t")).alias("w"))
    data = aligned.join(w, ["basket", "symbol"])
    series = data.groupBy("basket", "ts").agg(F.sum(F.col("w") * F.col("ret")).alias("p"))
    vol = series.groupBy("basket").agg((F.stddev_samp("p") * YEAR**0.5).alias("portfolio_vol"))
    own = data.groupBy("basket", "symbol").agg(F.first("w").alias("w"), (F.stddev_samp("ret") * YEAR**0.5).alias("v"))
    mean = own.groupBy("basket").agg(F.sum(F.col("w") * F.col("v")).alias("weighted_vol"))
    return vol.join(mean, "basket").select(
        "basket", "portfolio_vol", "weighted_vol",
        (F.col("weighted_vol") - F.col("portfolio_vol")).alias("benefit"),
        F.when(F.col("portfolio_vol") > 1e-9, sdiv(F.col("weighted_vol"), F.col("portfolio_vol"))).alias("ratio"))


def uniform(*parts: Column) -> Column:
    """A repeatable number in (0, 1) from the md5 of its parts, for seeded resampling."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0


def candidates(names: DataFrame, n: int = 500) -> DataFrame:
    """Long-only weight vectors: equal weight (0), then seeded draws from the flat Dirichlet."""
    draw = names.withColumn("candidate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))))
    raw = F.when(F.col("candidate") == 0, 1.0).otherwise(-F.log(uniform(F.col("candidate"), F.col("symbol"))))
    part = Window.partitionBy("basket", "candidate")
    return draw.withColumn("_e", raw).withColumn("weight", F.col("_e") / F.sum("_e").over(part)).drop("_e")


#: Dates and candidates of one product of a block of returns with a block of weights.
DATES, CANDIDATES = 1024, 256


def _products(returns: pa.Table, weights: pa.Table) -> pa.Table:
    """Per candidate: days, sum and sum of squares of the weighted returns of one block of dates."""
    if not returns.num_rows or not weights.num_rows:
        return pa.table({"basket": pa.array([], pa.string()), "candidate": pa.array([], pa.int64()), "n": pa.array([], pa.int64()),
                         "s": pa.array([], pa.float64()), "ss": pa.array([], pa.float64())})
    names, member = np.unique(weights.column("w_symbol").to_numpy(zero_copy_only=False), return_inverse=True)
    candidates, candidate = np.unique(weights.column("candidate").to_numpy(), return_inverse=True)
    days, day = np.unique(returns.column("ts").cast(pa.int64()).to_numpy(), return_inverse=True)
    w, r = np.zeros((len(names), len(candidates))), np.zeros((len(days), len(names)))
    w[member, candidate] = weights.column("weight").to_numpy()
    r[day, np.searchsorted(names, returns.column("symbol").to_numpy(zero_copy_only=False))] = returns.column("ret").to_numpy()
    p = r @ w
    return pa.table({"basket": pa.array([returns.column("basket")[0].as_py()] * len(candidates), pa.string()), "candidate": pa.array(candidates, pa.int64()),
                     "n": pa.array(np.full(len(candidates), len(days)), pa.int64()), "s": p.sum(0), "ss": (p * p).sum(0)})


def score_candidates(aligned: DataFrame, cands: DataFrame, rf: float = P.RISK_FREE) -> DataFrame:
    """Return, volatility and Sharpe of every candidate: its weighted return series, a block of dates by a block of candidates at a time.

    A task multiplies two small matrices and sends one row per candidate; no pair of members is built, and neither a long history nor a large
    basket's candidates have to fit into one task.
    """
    blocks = aligned.groupBy("basket").agg(F.ceil(F.count_distinct("ts") / DATES).cast("int").alias("_dates"))
    parts = cands.groupBy("basket").agg((F.floor(F.max("candidate") / CANDIDATES) + 1).cast("int").alias("_parts"))
    size = blocks.join(parts, "basket")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = aligned.join(size, "basket").select("basket", F.pmod(F.xxhash64("ts"), F.col("_dates")).cast("int").alias("d"), upto("_parts").alias("c"), "symbol", "ts", "ret")
    right = cands.join(size, "basket").select(
        F.col("basket").alias("w_basket"), upto("_dates").alias("w_d"), F.floor(F.col("candidate") / CANDIDATES).cast("int").alias("w_c"),
        F.col("symbol").alias("w_symbol"), F.col("candidate").alias("candidate"), F.col("weight").alias("weight"))
    found = left.groupBy("basket", "d", "c").cogroup(right.groupBy("w_basket", "w_d", "w_c")).applyInArrow(
        _products, "basket string, candidate long, n long, s double, ss double")
    total = found.groupBy("basket", "candidate").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    var = sdiv(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1) * YEAR
    out = total.select("basket", "candidate", (F.col("s") / F.col("n") * YEAR).alias("exp_return"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("vol"))
    return out.withColumn("sharpe", F.when(F.col("vol") > 1e-9, sdiv(F.col("exp_return") - rf, F.col("vol"))))


#: A pivot below this share of the largest variance counts as none: the members' returns depend on each other.
SINGULAR = 1e-10


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _cholesky(cov: Column) -> Column:
    """Rows of the lower triangle L with L L' = cov, as nested folds over arrays; NULLs from the first pivot that is none."""
    rows, none = F.array().cast("array<array<double>>"), F.array().cast("array<double>")
    largest = F.array_max(F.transform(cov, lambda r, i: r[i]))

    def next_row(done: Column, i: Column) -> Column:
        def next_cell(row: Column, j: Column) -> Column:
            left = cov[i][j] - F.when(j == i, _dot(row, row)).otherwise(_dot(row, F.slice(F.get(done, j), 1, j)))
            pivot = F.when(left > largest * SINGULAR, F.sqrt(left))
            return F.concat(row, F.array(F.when(j == i, pivot).otherwise(left / F.get(F.get(done, j), j))))

        return F.concat(done, F.array(F.aggregate(F.sequence(F.lit(0), i), none, next_cell)))

    return F.aggregate(F.sequence(F.lit(0), F.size(cov) - 1), rows, next_row)


def min_variance_short(aligned: DataFrame, rf: float = P.RISK_FREE) -> DataFrame:
    """(basket, symbol, weight, exp_return, vol, sharpe, status): the least variance if weights may be negative, sum 1.

    In closed form the weights are proportional to the solution of cov x = 1; it is solved by a Cholesky factor, forward and backward.
    A basket whose covariance has no inverse gets NULLs and the status ``singular``.
    """
    cov = pair_statistics(aligned).groupBy("basket", "a").agg(F.array_sort(F.collect_list(F.struct("b", "cov"))).alias("row"))
    mean = aligned.groupBy("basket", F.col("symbol").alias("a")).agg((F.avg("ret") * YEAR).alias("mu"))
    # one row a basket: the matrix of its pairs, which is the result of pair_statistics already
    whole = cov.join(mean, ["basket", "a"]).groupBy("basket").agg(F.array_sort(F.collect_list(F.struct("a", "mu", F.col("row.cov").alias("cov")))).alias("m"))
    whole = whole.select("basket", F.col("m.a").alias("names"), F.col("m.mu").alias("mu"), F.col("m.cov").alias("cov"), F.size("m").alias("n"))
    whole = whole.withColumn("low", _cholesky(F.col("cov")))
    none = F.array().cast("array<double>")
    cell = lambda i, j: F.get(F.get(F.col("low"), i), j)
    forward = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), none, lambda y, i: F.concat(
        y, F.array((1 - _dot(y, F.slice(F.get(F.col("low"), i), 1, i))) / cell(i, i))))
    whole = whole.withColumn("y", forward)

    def back(x: Column, step: Column) -> Column:
        i = F.col("n") - 1 - step  # x holds the solution behind i
        behind = F.transform(x, lambda v, k: v * cell(i + 1 + k, i))
        return F.concat(F.array((F.get(F.col("y"), i) - F.aggregate(behind, F.lit(0.0), lambda a, v: a + v)) / cell(i, i)), x)

    whole = whole.withColumn("x", F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), none, back))
    whole = whole.withColumn("t", F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    whole = whole.withColumn("w", F.transform("x", lambda v: sdiv(v, F.col("t"))))
    # x' cov x = sum of x, so the least variance is 1 / sum
    out = whole.select("basket", "names", "w", _dot(F.col("w"), F.col("mu")).alias("exp_return"), F.when(F.col("t") > 0, F.sqrt(sdiv(F.lit(1.0), F.col("t")))).alias("vol"))
    out = out.withColumns({
        "sharpe": F.when(F.col("vol") > 1e-9, sdiv(F.col("exp_return") - rf, F.col("vol"))), "status": F.when(F.col("vol").isNull(), "singular").otherwise("ok")})
    member = F.explode(F.arrays_zip("names", "w")).alias("s")
    return out.select("basket", member, "exp_return", "vol", "sharpe", "status").select(
        "basket", F.col("s.names").alias("symbol"), F.when(F.col("status") == "ok", F.col("s.w")).alias("weight"), "exp_return", "vol", "sharpe", "status")


def best_candidates(scored: DataFrame) -> DataFrame:
    """Minimum-variance, maximum-Sharpe and equal-weight candidates of every basket."""
    pick = scored.groupBy("basket").agg(
        F.min_by("candidate", "vol").alias("min_variance"), F.max_by("candidate", "sharpe").alias("max_sharpe"),
        F.lit(0).cast("long").alias("equal_weight"))
    long = pick.unpivot("basket", ["min_variance", "max_sharpe", "equal_weight"], "portfolio", "candidate")
    return long.join(scored, ["basket", "candidate"])


def frontier(scored: DataFrame, points: int = 25) -> DataFrame:
    """Lowest-volatility candidate in each return bucket from the minimum-variance return to the best return."""
    ends = scored.groupBy("basket").agg(F.min_by("exp_return", "vol").alias("lo"), F.max("exp_return").alias("hi"))
    inside = scored.join(ends, "basket").where(F.col("exp_return") >= F.col("lo"))
    slot = F.least(F.floor(sdiv(F.col("exp_return") - F.col("lo"), F.col("hi") - F.col("lo")) * points), F.lit(points - 1))
    return inside.withColumn("point", F.coalesce(slot, F.lit(0)).cast("long")).groupBy("basket", "point").agg(
        F.min_by("candidate", "vol").alias("candidate"), F.min_by("exp_return", "vol").alias("exp_return"), F.min("vol").alias("vol"))


def momentum(bars: DataFrame) -> DataFrame:
    out = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min_by("close", "ts").alias("_f"), F.max_by("close", "ts").alias("_l"))
    return out.select("symbol", "bars", F.when(F.col("bars") >= 2, sdiv(F.col("_l"), F.col("_f")) - 1).alias("momentum"))
