"""OHLCV bars from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"day": "DAY", "hour": "HOUR", "month": "MONTH", "year": "YEAR", "minute": "MINUTE"}


def bar_aggregates() -> list[Column]:
    """``seq`` is a BIGINT that orders the ticks of one bar.  A primitive order key keeps the whole
    aggregation in hash aggregates with map-side partials; a struct key would make Spark sort the ticks."""
    return [
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("volume"),
    ]


def bars(ticks: DataFrame, freq: str = "day") -> DataFrame:
    """ticks(symbol, ts, seq, price, qty) -> bars(symbol, ts, open, high, low, close, volume).

    However hot a symbol is, each task sends one row per (symbol, bar) to the shuffle.
    """
    start = F.date_trunc(UNITS[freq], F.col("ts")).cast("timestamp_ntz")
    return ticks.groupBy("symbol", start.alias("ts")).agg(*bar_aggregates())


def bars_from_bars(source: DataFrame, freq: str) -> DataFrame:
    """Coarser bars from finer ones."""
    start = F.date_trunc(UNITS[freq], F.col("ts")).cast("timestamp_ntz")
    return source.groupBy("symbol", start.alias("ts")).agg(
        F.min_by("open", source["ts"]).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", source["ts"]).alias("close"), F.sum("volume").alias("volume"),
    )
