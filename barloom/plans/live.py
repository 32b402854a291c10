"""Streaming queries, run to the end of their input and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.series import rounded
from barloom.plans.base_sql import HOURLY
from barloom.plans.registry import query
from barloom.session import ensure_checkpoint_dir
from barloom.sources.market import order_in_day
from barloom.sources.tables import table
from barloom.streaming.alerts import watch, watch_rest
from barloom.streaming.bars import newest_bars, stream_bars, upsert_bars


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return events.select(
        F.col("event_type").alias("symbol"), "ts", order_in_day(F.col("ts"), F.col("event_id")).alias("seq"),
        (100 + 0.5 * F.sqrt("value")).alias("price"), F.lit(1.0).alias("qty"))


def _workspace(spark):
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_bars_hourly", f"""WITH {HOURLY} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM hourly""")
def _(spark, sf):
    out = _workspace(spark)
    upsert_bars(stream_bars(_event_stream(spark, sf)), f"{out}/bars", f"{out}/log").awaitTermination()
    return rounded(newest_bars(spark, f"{out}/bars").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("stream_new_triggers", f"""WITH {HOURLY}, e AS (SELECT symbol || '/' || t AS rule_id, ts, close >= t AS is_met FROM hourly, (VALUES (106), (108)) v(t)),
  l AS (SELECT *, coalesce(lag(is_met) OVER (PARTITION BY rule_id ORDER BY ts), false) AS was FROM e)
  SELECT rule_id, ts FROM l WHERE is_met AND NOT was""")
def _(spark, sf):
    """Price rules evaluated on bars as they are finished, then on those that are still open when the input ends."""
    out = _workspace(spark)
    level = F.explode(F.array(F.lit(106), F.lit(108))).alias("t")

    def evaluated(bars):
        return bars.select("symbol", "ts", "close", level).select(
            F.concat_ws("/", "symbol", F.col("t").cast("string")).alias("rule_id"), "ts", (F.col("close") >= F.col("t")).alias("is_met"))

    def deliver(fired, batch_id):
        fired.select("rule_id", F.col("ts").cast("timestamp_ntz").alias("ts")).write.mode("overwrite").parquet(f"{out}/fired/batch={batch_id}")

    upsert_bars(stream_bars(_event_stream(spark, sf)), f"{out}/bars", f"{out}/bars-log").awaitTermination()
    watch(evaluated(stream_bars(_event_stream(spark, sf))), f"{out}/state", deliver, f"{out}/log").awaitTermination()
    watch_rest(evaluated(newest_bars(spark, f"{out}/bars")), f"{out}/state", deliver)
    return spark.read.parquet(f"{out}/fired").select("rule_id", "ts")
