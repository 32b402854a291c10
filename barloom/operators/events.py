"""Edge detection: one row per crossing or breakout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import over_time


def crossings(df: DataFrame, a: str, b: str, indicator: str, level: str | None = None) -> DataFrame:
    """Rows where "a above b" flips; NULL rows are removed first, equality counts as not above."""
    valid = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_up", F.col(a) > F.col(b))
    flips = valid.withColumn("_before", F.lag("_up").over(over_time())).where(F.col("_up") != F.col("_before"))
    return flips.select(
        "symbol", "ts", F.lit(indicator).alias("indicator"),
        F.when(F.col("_up"), "bullish").otherwise("bearish").alias("kind"),
        F.col("close").alias("price"), F.col(level or b).alias("level"),
    )


def breakouts(df: DataFrame) -> DataFrame:
    """Entering the zone above the upper or below the lower Bollinger band."""
    valid = df.where(F.col("bb_upper").isNotNull() & F.col("bb_lower").isNotNull()).withColumn(
        "_state",
        F.when(F.col("close") > F.col("bb_upper"), "upper")
        .when(F.col("close") < F.col("bb_lower"), "lower").otherwise("inside"),
    )
    entered = valid.withColumn("_before", F.lag("_state").over(over_time())).where(
        (F.col("_state") != F.col("_before")) & (F.col("_state") != "inside"))
    return entered.select(
        "symbol", "ts", F.lit("bollinger").alias("indicator"), F.col("_state").alias("kind"),
        F.col("close").alias("price"),
        F.when(F.col("_state") == "upper", F.col("bb_upper")).otherwise(F.col("bb_lower")).alias("level"),
    )


def newest_events(events: DataFrame, n: int = 10) -> DataFrame:
    """The latest n events of every (symbol, indicator), newest first."""
    w = Window.partitionBy("symbol", "indicator").orderBy(F.col("ts").desc(), "kind")
    return events.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def recent_events(events: DataFrame, bars: DataFrame, n: int = 10) -> DataFrame:
    """Events dated at or after the n-th last bar of their symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    cutoff = (
        bars.select("symbol", "ts", F.row_number().over(w).alias("_r")).where(F.col("_r") <= n)
        .groupBy("symbol").agg(F.min("ts").alias("_cut"))
    )
    return events.join(cutoff, "symbol").where(F.col("ts") >= F.col("_cut")).drop("_cut")
