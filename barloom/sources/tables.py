"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars_between(bars: DataFrame, symbols: Sequence[str] | None = None, start: str | None = None,
                 end: str | None = None) -> DataFrame:
    """Bars of some symbols in [start, end); the predicates reach the scan of a stored bar table."""
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(*symbols))
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return bars


def bars_of(bars: DataFrame, keys: DataFrame) -> DataFrame:
    """Bars of the symbols listed in a (possibly large) key table."""
    return bars.join(keys.select("symbol").distinct(), "symbol", "left_semi")


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store bars by year, so date ranges prune folders, with symbols clustered inside each file."""
    (
        bars.withColumn("year", F.year("ts"))
        .repartitionByRange("year", "symbol")
        .sortWithinPartitions("year", "symbol", "ts")
        .write.mode(mode).partitionBy("year").parquet(path)
    )


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Export a report (indicator, risk or scorecard table) as CSV with a header, one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)


def drop_below(spark: SparkSession, path: str, column: str, least: int) -> None:
    """Delete the partitions ``column=n`` of a table with n below ``least``, on whatever store the path names."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in store.listStatus(folder):
        name, _, value = entry.getPath().getName().partition("=")
        if name == column and value.isdigit() and int(value) < least:
            store.delete(entry.getPath(), True)
