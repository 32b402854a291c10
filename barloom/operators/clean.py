"""Bar cleaning with an audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import prev, whole

REQUIRED = ("open", "high", "low", "close", "volume")
GAP_MULTIPLE = 5  # fixed value: spacing above this multiple of the typical one is a gap


def local_time(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, keeping the wall time."""
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def adjusted_close(df: DataFrame) -> DataFrame:
    return df.withColumn("close", F.col("adj_close")).drop("adj_close") if "adj_close" in df.columns else df


def drop_duplicates(df: DataFrame) -> DataFrame:
    """First row per (symbol, ts) by ``ingest_id``; ``copies`` counts what was there.

    A grouped min_by combines map-side, so a timestamp repeated a million times is no hot spot.
    """
    cols = [c for c in df.columns if c not in ("symbol", "ts", "ingest_id")]
    return df.groupBy("symbol", "ts").agg(
        *[F.min_by(c, "ingest_id").alias(c) for c in cols], F.count(F.lit(1)).alias("copies"))


def is_valid(df: DataFrame) -> Column:
    """False for impossible or incomplete bars; true everywhere when a column is absent altogether."""
    if any(c not in df.columns for c in REQUIRED):
        return F.lit(True)
    o, h, low, c, v = (F.col(x) for x in REQUIRED)
    ok = (o > 0) & (h > 0) & (low > 0) & (c > 0) & (v >= 0) & (h >= low) & o.between(low, h) & c.between(low, h)
    return F.coalesce(ok, F.lit(False))


def marked(raw: DataFrame) -> DataFrame:
    df = adjusted_close(drop_duplicates(local_time(raw)))
    return df.withColumn("valid", is_valid(df))


def clean(raw: DataFrame) -> DataFrame:
    return marked(raw).where("valid").drop("valid", "copies")


def gaps(bars: DataFrame) -> DataFrame:
    """Spacings wider than five times the symbol's median spacing (at least three bars)."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    step = bars.select("symbol", "ts", prev(F.col("ts")).alias("previous"), (t - prev(t)).alias("spacing"))
    step = step.withColumns({
        "typical": F.percentile("spacing", F.lit(0.5)).over(whole()), "_n": F.count(F.lit(1)).over(whole())})
    wide = (F.col("_n") >= 3) & (F.col("typical") > 0) & (F.col("spacing") > GAP_MULTIPLE * F.col("typical"))
    day = 86_400_000_000
    return step.where(wide).select(
        "symbol", "previous", "ts", F.floor(F.col("spacing") / day).alias("days"), F.floor(F.col("typical") / day).alias("typical_days"))


def audit(raw: DataFrame) -> DataFrame:
    """Per symbol: duplicates and invalid rows removed, gaps, and whether anything was found."""
    frame = marked(raw)
    counts = frame.groupBy("symbol").agg(
        F.sum(F.col("copies") - 1).alias("duplicates"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if("valid").alias("bars"))
    found = gaps(frame.where("valid")).groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"))
    out = counts.join(found, "symbol", "left").fillna(0, ["gaps"])
    issues = F.col("duplicates") + F.col("invalid") + F.col("gaps")
    return out.withColumns({"issues": issues, "is_clean": issues == 0})
