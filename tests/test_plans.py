"""Physical plans: what scales and what does not is decided here, so it is pinned."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.operators import indicators as ti
from barloom.plans.registry import QUERIES, SQL
from barloom.sources.market import bars_daily
from barloom.sources.tables import bars_between, write_bars

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_use_hash_aggregates_and_prune_columns(spark):
    p = plan(bars_daily(spark, SF))
    assert "SortAggregate" not in p and p.count("HashAggregate") == 2
    assert "l_tax" not in p and "PushedFilters: [IsNotNull(l_quantity)" in p


def test_indicator_stack_keeps_one_shuffle_by_symbol(spark):
    frame = ti.bollinger(ti.macd(ti.rsi(ti.sma(bars_daily(spark, SF).select("symbol", "ts", "close"), [20]))))
    p = plan(frame)
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    assert [s for s in shuffles if s.startswith("symbol#") and "ts#" not in s and s.count("#") == 1] and len(shuffles) <= 4
    assert "CartesianProduct" not in p and "SinglePartition" not in p


def test_stored_bars_prune_by_year_and_symbol(spark, tmp_path):
    write_bars(bars_daily(spark, SF), str(tmp_path / "bars"))
    stored = spark.read.parquet(str(tmp_path / "bars")).where("year = 1997")
    p = plan(bars_between(stored, ["Brand#3"], "1997-01-01", "1998-01-01"))
    assert "PartitionFilters: [isnotnull(year" in p and "EqualTo(symbol,Brand#3)" in p


def test_date_ranges_reach_the_tick_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for name, since in (("src_bars_range", "1997-01-01"), ("dg_moves", "2001-05-31")):
        p = plan(QUERIES[name](spark, SF))
        assert re.search(rf"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate,{since}", p) and "LessThan(l_shipdate" in p, name
    p = plan(bars_daily(spark, SF, "2000-06-30", "2001-06-30"))
    assert "GreaterThanOrEqual(l_shipdate,2000-06-30" in p


def test_ticks_of_one_instant_keep_their_order(spark):
    """Ids decide within an instant, also far past 2041 and beyond the ids that the key tells apart."""
    import datetime as dt

    from pyspark.sql import functions as F

    from barloom.sources.bars import bars
    from barloom.sources.market import IDS, order_in_day

    rows = []
    for year in (1950, 1970, 2024, 2300):
        at = dt.datetime(year, 3, 1, 10, 59, 59, 999999)
        rows += [("A", at, IDS * 7 + i, float(i)) for i in (3, 1, 4099, 2)] + [("A", at - dt.timedelta(seconds=1), IDS * 9, 50.0)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, price double").withColumns({"seq": order_in_day(F.col("ts"), F.col("id")), "qty": F.lit(1.0)})
    for freq in ("hour", "day", "minute"):
        assert {(r.open, r.close) for r in bars(ticks, freq).collect()} == {(50.0, 4099.0)}


def test_no_query_builds_a_cartesian_product(spark):
    for name in ("sc_sector_percentiles", "sc_suggestions", "fa_dcf_grid", "pa_candidates", "th_effective", "mc_gbm"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, SF)), name


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(set(QUERIES) - set(SQL)) <= 3


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", ["bars_hourly", "ind_rsi", "risk_max_drawdown", "fa_scorecard", "sc_sector_percentiles", "cl_audit", "ns_score_text", "th_effective", "bt_run_mixed"])
def test_matches_sql(spark, name):
    from tools.check import compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert compare(QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).fetchdf()) is None
