"""Market tables derived from the star-schema and event tables.

symbol = part brand, one tick per line item, dated by ship date.  The unit
price is compressed by a square root, so that daily moves are a few percent as
in a market table; a square root is exactly rounded, hence engine-independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import bars
from barloom.sources.tables import table

BENCHMARK = "MKT"


def line_ticks(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One tick per line item, in [start, end) if given; ``seq`` packs order, line and part into one BIGINT.

    The dates are predicates on the stored column, so they reach the Parquet scan.
    """
    lines = table(spark, folder, "lineitem").where(F.col("l_quantity") > 0)
    kind = lines.schema["l_shipdate"].dataType
    if start is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(start).cast(kind))
    if end is not None:
        lines = lines.where(F.col("l_shipdate") < F.lit(end).cast(kind))
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        "symbol",
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 8192 + F.col("l_linenumber") * 1024 + F.col("l_partkey") % 1024).alias("seq"),
        (100 + 0.05 * F.sqrt(F.col("l_extendedprice") / F.col("l_quantity"))).alias("price"),
        F.col("l_quantity").alias("qty"),
    )


#: Ids that one instant can tell apart; 37 bits hold the microsecond of a day, 26 the id, so the key never overflows.
IDS, DAY_MICROS = 1 << 26, 86_400_000_000


def order_in_day(ts: Column, tick_id: Column) -> Column:
    """One BIGINT that orders the ticks of a day, and so of every bar up to a day, by instant and id."""
    return F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(DAY_MICROS)) * IDS + F.pmod(tick_id, F.lit(IDS))


def event_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """One tick per event."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        order_in_day(F.col("ts"), F.col("event_id")).alias("seq"),
        (100 + 0.5 * F.sqrt("value")).alias("price"),
        F.lit(1.0).alias("qty"),
    )


def bars_daily(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return bars(line_ticks(spark, folder, start, end), "day")


def bars_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return bars(event_ticks(spark, folder), "hour")


def benchmark(daily: DataFrame) -> DataFrame:
    """Equal-weight mean close per date: (ts, bench)."""
    return daily.groupBy("ts").agg(F.avg("close").alias("bench"))


def brand_number(symbol: str = "symbol"):
    return F.regexp_extract(F.col(symbol), r"(\d+)", 1).cast("int")


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    """members(basket, symbol, weight): every brand belongs to one of five baskets."""
    names = table(spark, folder, "part").select(F.col("p_brand").alias("symbol")).distinct()
    n = brand_number()
    return names.select(
        F.concat(F.lit("basket"), (n % 5).cast("string")).alias("basket"), "symbol", (1.0 + n % 3).alias("weight"))


def lots(spark: SparkSession, folder: str) -> DataFrame:
    """lots(portfolio, symbol, purchase_date, shares, cost): the purchases of a customer segment, summed per day."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("purchase_date"))
    owners = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("portfolio"))
    lines = table(spark, folder, "lineitem").where(F.col("l_quantity") > 0)
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    bought = (
        lines.join(parts, lines.l_partkey == parts.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(owners, F.col("o_custkey") == F.col("c_custkey"))
    )
    price = 100 + 0.05 * F.sqrt(F.col("l_extendedprice") / F.col("l_quantity"))
    return bought.groupBy("portfolio", "symbol", "purchase_date").agg(
        F.sum("l_quantity").alias("shares"), F.sum(F.col("l_quantity") * price).alias("cost"))


RESERVED = {"benchmark": BENCHMARK, "fear": "error", "yield": "view"}


def macro_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """(ts, benchmark, fear, yield): the reserved series side by side, one row per day."""
    base = benchmark(bars_daily(spark, folder)).withColumnRenamed("bench", "benchmark")
    daily = bars(event_ticks(spark, folder), "day")
    picked = daily.where(F.col("symbol").isin(RESERVED["fear"], RESERVED["yield"]))
    side = picked.groupBy("ts").agg(*[F.max(F.when(F.col("symbol") == RESERVED[n], F.col("close"))).alias(n) for n in ("fear", "yield")])
    return base.join(side, "ts", "full")
