import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators.backtest import Condition, Rule


def test_positions_against_loop(bars):
    rule = bt.mean_reversion(-1.0, 0.5)
    got = bt.run(bt.prepare(bars), rule, 10.0).where("symbol = 'AAA'").orderBy("ts").toPandas()
    pos, held = 0.0, []
    for z in got["zscore"]:
        if z > 0.5:
            pos = 0.0
        elif z < -1.0:
            pos = 1.0
        held.append(pos)
    assert list(got["position"]) == held
    h = pd.Series(held)
    net = h.shift() * got["r"] - h.diff().abs() * 0.001
    assert np.allclose(got["net_equity"][1:], (1 + net[1:]).cumprod())
    assert np.isnan(got["equity"].iloc[0])


def test_unknown_indicator_raises():
    with pytest.raises(ValueError):
        bt.holds(Condition("nope", "<", 1.0))


def test_empty_exit_never_fires(bars):
    rule = Rule("hold", (Condition("zscore", ">", -99.0),), "AND", (), "AND")
    s = bt.summarize(bt.run(bt.prepare(bars), rule)).toPandas()
    assert (s["trades"] == 1).all() and (s["conflicts"] == 0).all()


def test_walk_forward_windows_do_not_share_state(bars):
    rule = bt.mean_reversion(-1.0, 0.5)
    prepared = bt.prepare(bars)
    oos = bt.walk_forward(prepared, rule, 100, 40)
    got = bt.walk_windows(oos).where("symbol = 'AAA'").orderBy("window").toPandas()
    p = prepared.where("symbol = 'AAA'").orderBy("ts").toPandas()
    want = []
    start = 100
    while start + 40 <= len(p):
        part = p.iloc[start - 100:start + 40]
        pos, held = 0.0, []
        for z in part["zscore"]:
            pos = 0.0 if z > 0.5 else 1.0 if z < -1.0 else pos
            held.append(pos)
        h = pd.Series(held, index=part.index)
        want.append((np.prod(1 + (h.shift() * part["r"]).iloc[100:].fillna(0)) - 1) * 100)
        start += 40
    assert np.allclose(got["return_pct"], want)


def test_short_history_has_reason(bars):
    rule = bt.mean_reversion()
    r = bt.walk_summary(bt.walk_forward(bt.prepare(bars), rule, 500, 100), bars, 500, 100).first()
    assert not r.ok and "600 needed" in r.reason


def loop_portfolio(wide, target, freq=None, threshold=None):
    weights, out, prev = target.copy(), [], None
    for ts, row in wide.iterrows():
        reset = False
        if freq and prev is not None and (ts.year, ts.month) != (prev.year, prev.month):
            reset = True
        if threshold is not None and np.abs(weights - target).max() * 100 > threshold:
            reset = True
        if reset:
            weights = target.copy()
        out.append(weights.copy())
        grown = weights * (1 + row.to_numpy())
        weights = grown / grown.sum() if grown.sum() > 0 else target.copy()
        prev = ts
    return np.array(out)


@pytest.fixture()
def returns(spark):
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2023-01-02", periods=120)
    rows = [("p", s, d.to_pydatetime(), float(v), t) for s, t in (("A", 0.5), ("B", 0.3), ("C", 0.2)) for d, v in zip(days, rng.normal(0, 0.05, 120))]
    return spark.createDataFrame(rows, "basket string, symbol string, ts timestamp_ntz, net_r double, target double")


@pytest.mark.parametrize("freq,threshold", [("none", None), ("monthly", None), ("none", 5.0), ("monthly", 5.0)])
def test_drift_matches_loop(returns, freq, threshold):
    pdf = returns.toPandas()
    wide = pdf.pivot(index="ts", columns="symbol", values="net_r")
    want = loop_portfolio(wide, np.array([0.5, 0.3, 0.2]), freq if freq == "monthly" else None, threshold)
    out = bt.drifting_weights(returns, freq, threshold)
    got = out.toPandas().pivot(index="ts", columns="symbol", values="weight")
    assert np.allclose(got.to_numpy(), want)


@pytest.mark.parametrize("freq,threshold", [("none", None), ("monthly", None), ("monthly", 5.0)])
def test_lost_total_goes_back_to_the_targets(spark, returns, freq, threshold):
    """On one day all members lose everything, on another the total is negative; a second basket is not touched by it."""
    pdf = returns.toPandas()
    days = sorted(pdf["ts"].unique())
    pdf.loc[pdf["ts"] == days[30], "net_r"] = -1.0
    pdf.loc[pdf["ts"] == days[60], "net_r"] = -1.5
    both = spark.createDataFrame(pdf, returns.schema).union(returns.withColumn("basket", F.lit("q")))
    out = bt.drifting_weights(both, freq, threshold).toPandas()
    assert len(out) == 720
    for basket, part in (("p", pdf), ("q", returns.toPandas())):
        want = loop_portfolio(part.pivot(index="ts", columns="symbol", values="net_r"), np.array([0.5, 0.3, 0.2]), freq if freq == "monthly" else None, threshold)
        got = out[out["basket"] == basket].pivot(index="ts", columns="symbol", values="weight")
        assert np.allclose(got.to_numpy(), want)


def test_walk_holds_one_date_only():
    """A basket of 20,000 dates passes in batches of 64 rows; between batches no more than one date waits."""
    import pyarrow as pa

    dates, members = 20_000, ["A", "B", "C"]
    held = []

    def batches():
        rows = [("p", np.datetime64("1950-01-01") + d, m, 0.001 * (i - 1), 1 / 3, None) for d in range(dates) for i, m in enumerate(members)]
        for at in range(0, len(rows), 64):
            part = list(zip(*rows[at:at + 64]))
            held.append(len(part[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0]), pa.array(np.array(part[1], "datetime64[us]")), pa.array(part[2]), pa.array(part[3]), pa.array(part[4]), pa.array(part[5], pa.timestamp("us"))],
                ["basket", "ts", "symbol", "net_r", "target", "_p"])

    seen = 0
    for out in bt._walked(5.0)(batches()):
        seen += out.num_rows
        assert out.num_rows <= 64 + len(members) and seen >= sum(held) - 64 - len(members)
    assert seen == dates * len(members)


def test_contributions_sum_to_portfolio_return(returns):
    weighted = bt.drifting_weights(returns, "monthly")
    daily = bt.portfolio_curve(weighted)
    total = weighted.agg(F.sum("contribution")).first()[0]
    assert daily.agg(F.sum("r")).first()[0] == pytest.approx(total)


def test_bad_weights_are_reported(spark):
    w = spark.createDataFrame([("n", "A", -1.0), ("n", "B", 2.0), ("z", "A", 0.0), ("ok", "A", 3.0), ("ok", "B", 1.0)], "basket string, symbol string, weight double")
    got = {(r.basket, r.symbol): (r.status, r.target) for r in bt.normalized_weights(w).collect()}
    assert got[("n", "A")][0].startswith("negative") and got[("z", "A")][1] is None
    assert got[("ok", "A")] == ("ok", 0.75)
