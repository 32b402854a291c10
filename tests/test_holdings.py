import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import holdings as ph
from tests.conftest import closes

LOTS = "portfolio string, symbol string, purchase_date date, shares double, cost double"


def test_money_arriving_is_not_a_gain(spark):
    bars = closes(spark, [10.0] * 10, "A", "2026-01-01")
    lots = spark.createDataFrame([("p", "A", dt.date(2026, 1, 1), 10.0, 100.0), ("p", "A", dt.date(2026, 1, 8), 90.0, 900.0)], LOTS)
    series = ph.value_series(lots, bars)
    rows = series.orderBy("ts").collect()
    assert rows[0].value == 100.0 and rows[-1].value == 1000.0
    assert sum(r.flow for r in rows) == 1000.0
    assert ph.time_weighted(series).first().twr_pct == pytest.approx(0.0)


def test_weekend_purchase_lands_on_next_bar(spark):
    bars = closes(spark, [10.0] * 10, "A", "2026-01-01")
    lots = spark.createDataFrame([("p", "A", dt.date(2026, 1, 1), 1.0, 10.0), ("p", "A", dt.date(2026, 1, 3), 1.0, 10.0)], LOTS)
    flows = {r.ts.date(): r.flow for r in ph.value_series(lots, bars).collect()}
    assert flows[dt.date(2026, 1, 5)] == 10.0


def test_xirr_by_hand(spark):
    lots = spark.createDataFrame([("p", "A", dt.date(2023, 1, 1), 1.0, 100.0), ("q", "A", dt.date(2024, 1, 1), 1.0, 100.0)], LOTS)
    final = spark.createDataFrame([("p", dt.date(2024, 1, 1), 110.0), ("q", dt.date(2024, 1, 1), 110.0)], "portfolio string, end date, value double")
    got = {r.portfolio: r.mwr_pct for r in ph.money_weighted(lots, final).collect()}
    assert got["p"] == pytest.approx(10.0, abs=0.02)
    assert got["q"] is None  # all flows on one day


def test_unpriced_lot_is_excluded(spark):
    bars = closes(spark, [10.0, 12.0], "A", "2026-01-01")
    lots = spark.createDataFrame([("p", "A", dt.date(2026, 1, 1), 1.0, 10.0), ("p", "Z", dt.date(2026, 1, 1), 1.0, 10.0)], LOTS)
    t = ph.totals(ph.lot_performance(lots, bars)).first()
    assert (t.priced_lots, t.excluded_lots, t.market_value, t.gain_pct) == (1, 1, 12.0, pytest.approx(20.0))


def test_benchmark_fills_backward(spark):
    days = pd.bdate_range("2026-01-01", periods=3)
    series = spark.createDataFrame([("p", d.to_pydatetime(), v) for d, v in zip(days, [100.0, 110.0, 120.0])], "portfolio string, ts timestamp_ntz, value double")
    bench = spark.createDataFrame([(days[1].to_pydatetime(), 50.0), (days[2].to_pydatetime(), 75.0)], "ts timestamp_ntz, bench double")
    got = [r.benchmark for r in ph.rebased_benchmark(series, bench).orderBy("ts").collect()]
    assert got == [100.0, 100.0, 150.0]


def test_lot_problems(spark):
    lots = spark.createDataFrame([("p", "A", dt.date(2030, 1, 1), -1.0, 10.0), ("p", "A", dt.date(2020, 1, 1), 1.0, 0.0)], LOTS)
    got = [r.problems for r in ph.valid_lots(lots, F.lit("2026-01-01").cast("date")).orderBy("purchase_date").collect()]
    assert got[0] == "" and "positive" in got[1] and "future" in got[1]


def test_value_series_against_a_walk_by_day(spark):
    """Random lots of symbols with unlike calendars, against a loop over days and symbols."""
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    bars = [(s, start + dt.timedelta(days=d), rng.uniform(5, 50)) for s in "ABC" for d in range(60) if rng.random() < {"A": 0.9, "B": 0.4, "C": 0.2}[s]]
    lots = [(p, s, (start + dt.timedelta(days=rng.randrange(70))).date(), float(rng.randrange(1, 9)), rng.uniform(1, 90)) for p in "pq" for s in "ABCZ" for _ in range(4)]
    got = {(r.portfolio, r.ts): (r.value, r.flow) for r in ph.value_series(spark.createDataFrame(lots, LOTS), spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, close double")).collect()}
    want = {}
    for p in "pq":
        mine = [x for x in lots if x[0] == p]
        first, paid = min(x[2] for x in mine), 0.0
        for day in sorted({ts for _, ts, _ in bars if ts.date() >= first}):
            value = total = 0.0
            for _, s, bought, shares, cost in mine:
                if bought <= day.date() and s != "Z":
                    seen = [(ts, c) for b, ts, c in bars if b == s and first <= ts.date() and ts <= day]
                    value, total = value + (shares * max(seen)[1] if seen else 0.0), total + cost
            want[p, day], paid = (value, total - paid), total
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_one_row_per_event_not_per_day_and_symbol(spark):
    """Fifty symbols priced on days of their own: the timeline has a row per price and lot, the running sum one per day."""
    days = pd.bdate_range("2024-01-01", periods=50)
    bars = spark.createDataFrame([(f"S{i}", d.to_pydatetime(), 10.0) for i, d in enumerate(days)], "symbol string, ts timestamp_ntz, close double")
    lots = spark.createDataFrame([("p", f"S{i}", dt.date(2023, 12, 1), 1.0, 10.0) for i in range(50)], LOTS)
    changes = ph.value_changes(lots, bars)
    assert changes.count() == 51 and changes.where("priced").count() == 50
    series = ph.value_series(lots, bars)
    assert series.agg(F.max("value")).first()[0] == 500.0
    plan = series._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 3  # start of the portfolio, prices of held symbols, known symbols
