"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import stage
from barloom.sources.bars import bar_aggregates
from barloom.sources.tables import drop_below


def stream_bars(ticks: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """ticks(symbol, ts, seq, price, qty) as a stream -> bars.

    The state holds one row per open (symbol, window); ticks later than the watermark are dropped.  In append mode a bar
    is emitted once the watermark has passed its end, in update mode whenever it changes.
    """
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy("symbol", F.window("ts", width).alias("w")).agg(*bar_aggregates()).select(
        "symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


#: Batches after which the written partitions become one.
COMPACT_EVERY = 32


def upsert_bars(bars: DataFrame, path: str, log: str, compact_every: int = COMPACT_EVERY):
    """Write bars whenever they change, open ones too: one partition per batch, written anew if the batch is repeated.

    From time to time the newest state of all bars becomes the partition of the current batch, and the earlier ones go.  Whatever a failure leaves
    behind is older than what replaces it, so readers never see it.
    """
    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if batch and batch % compact_every == 0:
            spark = changed.sparkSession
            stage(newest_bars(spark, path)).write.mode("overwrite").parquet(f"{path}/batch={batch}")
            drop_below(spark, path, "batch", batch)

    return bars.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()


def newest_bars(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every bar that was ever written."""
    written = spark.read.parquet(path)
    values = F.struct(*[c for c in written.columns if c not in ("symbol", "ts", "batch")])
    return written.groupBy("symbol", "ts").agg(F.max_by(values, "batch").alias("v")).select("symbol", "ts", "v.*")
