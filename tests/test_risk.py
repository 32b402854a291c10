import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import portfolio as pa
from barloom.operators import risk as rk
from tests.conftest import closes


def test_drawdown_by_hand(spark):
    r = rk.max_drawdown(closes(spark, [100, 120, 90, 60, 110, 120, 130])).first()
    assert r.max_drawdown == pytest.approx(-0.5)
    assert (r.peak_price, r.trough_price, r.recovered, r.recovery_days) == (120.0, 60.0, True, 2)


def test_never_falling_series_recovers_at_once(spark):
    r = rk.max_drawdown(closes(spark, [1, 2, 3])).first()
    assert (r.max_drawdown, r.recovered, r.recovery_days) == (0.0, True, 0)


def test_last_peak_before_trough(spark):
    r = rk.max_drawdown(closes(spark, [100, 90, 100, 50])).first()
    assert r.peak_ts == pd.bdate_range("2024-01-01", periods=4)[2].to_pydatetime()
    assert not r.recovered and r.recovery_days is None


def test_metrics_against_numpy(bars, frame):
    got = {r.symbol: r for r in rk.risk_metrics(bars).collect()}
    for s, p in frame.groupby("symbol"):
        lr = np.log(p.close / p.close.shift()).dropna()
        r = got[s]
        assert r.ann_vol == pytest.approx(lr.std() * math.sqrt(252))
        assert r.sharpe == pytest.approx((lr.mean() * 252 - 0.04) / (lr.std() * math.sqrt(252)))
        tail = lr.tail(252)
        assert r.hist_var == pytest.approx(tail.quantile(0.05))
        assert r.expected_shortfall == pytest.approx(tail[tail <= tail.quantile(0.05)].mean())
        assert r.expected_shortfall <= r.hist_var


def test_scale_invariance(bars):
    a = rk.risk_metrics(bars).orderBy("symbol").toPandas()
    b = rk.risk_metrics(bars.withColumn("close", F.col("close") * 7)).orderBy("symbol").toPandas()
    for c in ("sharpe", "hist_var", "max_drawdown", "calmar"):
        assert np.allclose(a[c], b[c])


def test_too_few_returns_are_null(spark):
    r = rk.risk_metrics(closes(spark, [10, 11])).first()
    assert r.ann_vol is None and r.sharpe is None and r.hist_var is None


def numpy_hurst(close, min_window=10):
    x = np.log(close / close.shift()).dropna().to_numpy()
    n = len(x)
    sizes = sorted({int(s) for s in np.logspace(np.log10(min_window), np.log10(n // 2), 20) if int(s) >= min_window})
    pts = []
    for size in sizes:
        vals = []
        for i in range(n // size):
            w = x[i * size:(i + 1) * size]
            walk = np.cumsum(w - w.mean())
            if w.std() > 0:
                vals.append((walk.max() - walk.min()) / w.std())
        pts.append((size, np.mean(vals)))
    return np.polyfit(np.log([p[0] for p in pts]), np.log([p[1] for p in pts]), 1)[0]


def test_hurst_close_to_numpy(bars, frame):
    got = {r.symbol: r.hurst for r in rk.hurst(bars).collect()}
    for s, p in frame.groupby("symbol"):
        # the upper end of the grid may fall one below in floating point there; sizes then differ by one
        assert got[s] == pytest.approx(numpy_hurst(p.close), abs=0.02)


def test_risk_score_renormalizes(spark):
    row = spark.createDataFrame([("A", 0.15, None, None, None, None, None, None, None)], "symbol string, rolling_vol double, hist_var double, "
                                "expected_shortfall double, max_drawdown double, sharpe double, sortino double, calmar double, altman_z double")
    r = rk.risk_score(row).first()
    assert r.risk_score == 100.0 and r.factors == 1 and "hist_var" in r.excluded
    none = rk.risk_score(row.withColumn("rolling_vol", F.lit(None).cast("double"))).first()
    assert none.risk_score == 0.0 and none.factors == 0


def test_diversification_equals_matrix_form(spark, bars, frame):
    members = spark.createDataFrame([("p", "AAA"), ("p", "BBB")], "basket string, symbol string")
    aligned = pa.aligned_returns(bars, members)
    r = pa.diversification(aligned).first()
    wide = aligned.toPandas().pivot(index="ts", columns="symbol", values="ret")
    cov = wide.cov().to_numpy() * 252
    w = np.array([0.5, 0.5])
    assert r.portfolio_vol == pytest.approx(math.sqrt(w @ cov @ w))
    assert r.weighted_vol == pytest.approx(w @ np.sqrt(np.diag(cov)))


def test_beta_of_benchmark_is_one(spark, bars):
    bench = bars.where("symbol = 'AAA'").select("ts", F.col("close").alias("bench"))
    r = pa.capm_beta(bars.where("symbol = 'AAA'"), bench).first()
    assert r.beta == pytest.approx(1.0) and r.r_squared == pytest.approx(1.0)


def test_beta_needs_sixty_dates(spark, bars):
    short = bars.where("symbol = 'AAA' AND ts < '2023-02-01'")
    assert pa.capm_beta(short, short.select("ts", F.col("close").alias("bench"))).first().beta is None
