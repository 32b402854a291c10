import numpy as np
import pandas as pd
import pytest

from barloom.functions.smoothing import Smooth, _block_size, smooth
from tests.conftest import walk


def series(spark, n, seed=3):
    pdf = walk(n, seed)[["symbol", "ts", "close"]]
    return pdf, spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, close double").repartition(4)


@pytest.mark.parametrize("alpha", [1 / 14, 2 / 13, 0.5, 0.9, 0.02, 1.0])
def test_unseeded_matches_pandas(spark, alpha):
    pdf, df = series(spark, 1500)
    got = smooth(df, [Smooth("y", "close", alpha)]).orderBy("ts").toPandas()["y"]
    want = pdf["close"].ewm(alpha=alpha, adjust=False).mean()
    assert np.abs(got - want).max() < 1e-9


def test_long_series_crosses_blocks(spark):
    alpha = 0.9
    assert _block_size([Smooth("y", "x", alpha)])[alpha] < 400
    pdf, df = series(spark, 1500)
    got = smooth(df, [Smooth("y", "close", alpha), Smooth("z", "close", 1 / 14)]).orderBy("ts").toPandas()
    assert np.abs(got["y"] - pdf["close"].ewm(alpha=alpha, adjust=False).mean()).max() < 1e-9
    assert np.abs(got["z"] - pdf["close"].ewm(alpha=1 / 14, adjust=False).mean()).max() < 1e-9


def test_seed_is_mean_of_first_values(spark):
    pdf, df = series(spark, 200)
    got = smooth(df, [Smooth("y", "close", 2 / 13, seed=12)]).orderBy("ts").toPandas()["y"]
    x = pdf["close"].to_numpy()
    y, want = x[:12].mean(), [np.nan] * 11
    want.append(y)
    for v in x[12:]:
        y = y * 11 / 13 + v * 2 / 13
        want.append(y)
    assert got[:11].isna().all()
    assert np.abs(got[11:] - pd.Series(want)[11:]).max() < 1e-9


def test_positional_seed_skips_leading_null(spark):
    df = spark.createDataFrame([("A", i, None if i == 0 else float(i)) for i in range(8)], "symbol string, ts int, x double")
    got = [r.y for r in smooth(df, [Smooth("y", "x", 0.5, seed=4, positional=True)]).orderBy("ts").collect()]
    assert got[:3] == [None, None, None]
    assert got[3] == pytest.approx(2.0)  # mean of 1, 2, 3
    assert got[4] == pytest.approx(3.0)


def test_min_count_blanks_warm_up(spark):
    _pdf, df = series(spark, 30)
    got = smooth(df, [Smooth("y", "close", 0.2, min_count=14)]).orderBy("ts").toPandas()["y"]
    assert got[:13].isna().all() and got[13:].notna().all()


@pytest.mark.parametrize("seed", [None, 5])
@pytest.mark.parametrize("alpha", [1 / 14, 2 / 6, 0.9, 1.0])
def test_inner_nulls_are_no_steps(spark, alpha, seed):
    """Seeded: the recurrence over the non-null values, null elsewhere; unseeded: the same with the value carried on."""
    pdf = walk(1200, 5)[["symbol", "ts", "close"]]
    rng = np.random.default_rng(2)
    pdf.loc[rng.random(len(pdf)) < 0.2, "close"] = np.nan
    pdf.loc[[0, 1, 700, 701, 702], "close"] = np.nan
    df = spark.createDataFrame([(r.symbol, r.ts.to_pydatetime(), None if np.isnan(r.close) else r.close) for r in pdf.itertuples()],
                               "symbol string, ts timestamp_ntz, close double").repartition(3)
    got = smooth(df, [Smooth("y", "close", alpha, seed=seed), Smooth("z", "close", 0.5)]).orderBy("ts").toPandas()["y"].astype(float)
    known = pdf["close"].dropna()
    if seed:
        known = pd.concat([pd.Series([np.nan] * (seed - 1) + [known.iloc[:seed].mean()], index=known.index[:seed]), known.iloc[seed:]])
    want = known.ewm(alpha=alpha, adjust=False).mean().reindex(pdf.index)
    want = want if seed else want.ffill()
    assert (got.isna() == want.isna()).all() and np.nanmax(np.abs(got - want)) < 1e-9


def test_a_constant_with_nulls_stays(spark):
    rows = [("X", (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).to_pydatetime(), None if i in (20, 21, 30) else 100.0) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    specs = [Smooth("a", "close", 2 / 13), Smooth("b", "close", 1 / 3, seed=5), Smooth("c", "close", 0.1, seed=4, positional=True)]
    out = smooth(df, specs).toPandas()[["a", "b", "c"]].astype(float)
    assert np.nanmax(np.abs(out - 100.0)) < 1e-9 and out["b"].isna().sum() == 4 + 3 and out["c"].isna().sum() == 3


def test_like_columns_share_a_sort(spark, bars):
    """Two columns that are NULL on the same rows, smoothed together and one by one; the plan sorts once less."""
    from pyspark.sql import functions as F

    from barloom.functions.smoothing import Smooth, smooth

    gone = F.dayofmonth("ts") % 5 == 0
    df = bars.select("symbol", "ts", F.when(~gone, F.col("close")).alias("a"), F.when(~gone, F.col("high") - 3).alias("b"))
    both = smooth(df, [Smooth("x", "a", 0.1), Smooth("y", "b", 0.1, like="a"), Smooth("z", "a", 0.2)])
    apart = smooth(smooth(smooth(df, [Smooth("x", "a", 0.1)]), [Smooth("y", "b", 0.1)]), [Smooth("z", "a", 0.2)])
    left, right = (d.orderBy("symbol", "ts").toPandas() for d in (both, apart))
    for c in "xyz":
        assert (left[c] - right[c]).abs().max() < 1e-9 and (left[c].isna() == right[c].isna()).all()
    sorts = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Sort [")
    free = smooth(df, [Smooth("x", "a", 0.1), Smooth("y", "b", 0.1), Smooth("z", "a", 0.2)])
    assert sorts(both) < sorts(free)
