import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import alerts as al
from barloom.operators import ml
from barloom.operators import risk as rk
from barloom.sources.tables import export_csv, write_bars


@pytest.mark.parametrize("days", [[0], [0, 1], [0, 1, 2, 40, 41, 300, 301, 302, 1000], list(range(0, 700, 3))])
@pytest.mark.parametrize("share", [0.2, 0.5, 0.01, 0.99])
def test_split_date_is_the_kth_distinct_date(spark, days, share):
    at = [dt.datetime(2019, 11, 20) + dt.timedelta(days=d) for d in days]
    rows = spark.createDataFrame([(s, t) for s in "AB" for t in at], "symbol string, ts timestamp_ntz")
    cut = max(min(max(1, int(len(at) * (1 - share))), len(at) - 1), 0)
    got = ml.split_date(rows, share).collect()
    assert [r["_cut"] for r in got] == [at[cut]]
    split = ml.with_split(rows, share)
    assert {r.ts: r.is_test for r in split.collect()} == {t: t >= at[cut] for t in at}


def test_split_of_nothing(spark):
    rows = spark.createDataFrame([], "symbol string, ts timestamp_ntz")
    assert ml.with_split(rows).count() == 0


def test_split_lists_no_dates(spark, bars):
    assert "collect_set" not in ml.with_split(bars)._jdf.queryExecution().optimizedPlan().toString()


def test_model_and_history_survive_a_restart(spark, bars, tmp_path):
    split = ml.with_split(ml.dataset(bars))
    trained = ml.train(split, 5)
    for run in ("2024-01-01", "2024-02-01", "2024-03-01"):
        ml.save(trained, str(tmp_path / "model"), str(tmp_path / "history"), run)
    again = ml.load(str(tmp_path / "model"))
    rows = split.where("is_test")
    before, after = (ml.probabilities(m, rows).orderBy("symbol", "ts").toPandas()["probability_up"] for m in (trained.model, again))
    assert len(before) and (before - after).abs().max() < 1e-12
    runs = ml.history(spark, str(tmp_path / "history"))
    assert [r.run_at for r in runs.collect()] == ["2024-01-01", "2024-02-01", "2024-03-01"]
    assert [r.run_at for r in ml.history(spark, str(tmp_path / "history"), 2).collect()] == ["2024-02-01", "2024-03-01"]


def test_training_universe_keeps_the_first_basket(spark):
    a, b = (spark.createDataFrame([(s,) for s in names], "symbol string") for names in ("AB", "BC"))
    assert {(r.symbol, r.first_basket) for r in ml.training_universe(a, b, a).collect()} == {("A", 0), ("B", 0), ("C", 1)}


def test_exports_can_be_read_again(spark, bars, tmp_path):
    """Indicator, risk and bar tables as CSV with a header, and bars as a table by year."""
    risk = rk.risk_metrics(bars).select("symbol", "bars", "ann_vol")
    for name, df in (("risk", risk), ("bars", bars.withColumn("note", F.lit('a "quoted", text')))):
        export_csv(df, str(tmp_path / name))
        back = spark.read.option("header", True).csv(str(tmp_path / name))
        assert back.columns == df.columns and back.count() == df.count()
    assert back.first().note.startswith("a ")
    write_bars(bars, str(tmp_path / "table"))
    stored = spark.read.parquet(str(tmp_path / "table"))
    assert stored.count() == bars.count() and stored.drop("year").exceptAll(bars.select(*stored.drop("year").columns)).isEmpty()


def test_trigger_history_is_appended_once_per_run(spark, tmp_path):
    path = str(tmp_path / "fired")
    at = lambda d: dt.datetime(2024, 1, d)
    first, second = ([("r1", "A", at(1)), ("r2", "B", at(1))], [("r1", "A", at(2))])
    for run, rows in (("1", first), ("2", second), ("2", second)):
        al.append_history(spark.createDataFrame(rows, "rule_id string, symbol string, ts timestamp_ntz"), path, run)
    assert al.history(spark, path).count() == 3
    assert {(r.symbol, r.ts) for r in al.history(spark, path, 1).collect()} == {("A", at(2)), ("B", at(1))}
