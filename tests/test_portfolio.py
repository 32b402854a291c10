import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.series import with_previous
from barloom.operators import portfolio as pa

ALIGNED = "basket string, symbol string, ts timestamp_ntz, ret double"


def aligned(spark, baskets):
    rows = [(b, s, dt.datetime(2020, 1, 1) + dt.timedelta(days=d), float(v)) for b, m in baskets.items() for s, col in m.items() for d, v in enumerate(col)]
    return spark.createDataFrame(rows, ALIGNED)


@pytest.mark.parametrize("n", [2, 3, 7])
def test_min_variance_short_is_the_closed_form(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 0.02, (90, n)) @ rng.normal(0, 1, (n, n)) + 0.001
    got = pa.min_variance_short(aligned(spark, {"p": {f"S{i}": x[:, i] for i in range(n)}})).orderBy("symbol").collect()
    cov = np.cov(x.T) * 252
    w = np.linalg.solve(cov, np.ones(n))
    w /= w.sum()
    assert [r.weight for r in got] == pytest.approx(w.tolist()) and sum(r.weight for r in got) == pytest.approx(1.0)
    vol, mean = np.sqrt(w @ cov @ w), w @ x.mean(0) * 252
    assert got[0].vol == pytest.approx(vol) and got[0].exp_return == pytest.approx(mean) and got[0].sharpe == pytest.approx((mean - 0.04) / vol)
    # nothing near it, with weights that sum to 1, varies less
    for _ in range(50):
        step = rng.normal(0, 0.1, n)
        v = w + step - step.mean()
        assert v @ cov @ v >= w @ cov @ w - 1e-12


def test_dependent_members_are_singular(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 0.02, (2, 60))
    baskets = {"twice": {"A": a, "B": 2 * a}, "sum": {"A": a, "B": b, "C": a + b}, "flat": {"A": a, "B": np.zeros(60)}, "fine": {"A": a, "B": b}}
    got = pa.min_variance_short(aligned(spark, baskets)).collect()
    assert {r.basket: r.status for r in got} == {"twice": "singular", "sum": "singular", "flat": "singular", "fine": "ok"}
    assert all((r.weight is None and r.vol is None and r.sharpe is None) == (r.status == "singular") for r in got)


def test_candidates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pa, "DATES", 16)
    monkeypatch.setattr(pa, "CANDIDATES", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(0.001, 0.02, (100, 4))
    data = aligned(spark, {b: {f"S{i}": x[:, i] * k for i in range(4)} for b, k in (("p", 1), ("q", 2))})
    cands = pa.candidates(data.select("basket", "symbol").distinct(), 30)
    out = pa.score_candidates(data, cands)
    got = {(r.basket, r.candidate): r for r in out.collect()}
    assert len(got) == 62
    weights = cands.toPandas().pivot(index=["basket", "candidate"], columns="symbol", values="weight")
    for (basket, candidate), w in weights.iterrows():
        p = x * (1 if basket == "p" else 2) @ w.to_numpy()
        r = got[basket, candidate]
        assert (r.exp_return, r.vol) == (pytest.approx(p.mean() * 252), pytest.approx(p.std(ddof=1) * 252**0.5))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "covar" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1


def test_with_previous_crosses_years(spark):
    days = [dt.datetime(1999, 5, 1), dt.datetime(1999, 12, 31), dt.datetime(2003, 1, 2), dt.datetime(2003, 1, 3), dt.datetime(2004, 7, 1)]
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "ts timestamp_ntz, v double").repartition(3)
    out = with_previous(df, "v", "before")
    assert [r.before for r in out.orderBy("ts").collect()] == [None, 0.0, 1.0, 2.0, 3.0]
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_beta_plan_has_no_single_partition(bars):
    bench = bars.groupBy("ts").agg(F.avg("close").alias("bench"))
    out = pa.capm_beta(bars, bench)
    assert out.count() == 2
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
