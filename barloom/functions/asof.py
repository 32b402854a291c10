"""As-of lookup: the newest right-hand row at or before each left-hand row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str]) -> DataFrame:
    """Union both sides, carry the last right row forward, keep the left rows.

    One shuffle on ``by`` and one sort; no inequality join, so no row blow-up.
    """
    left_cols = [c for c in left.columns if c not in by and c != on]
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    tagged_left = left.select(
        *by, on, F.lit(1).alias("_side"), F.struct(*left_cols, F.lit(True).alias("_l")).alias("_left"),
        F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"),
    )
    tagged_right = right.select(
        *by, on, F.lit(0).alias("_side"),
        F.lit(None).cast(tagged_left.schema["_left"].dataType).alias("_left"),
        payload.alias("_right"),
    )
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged_left.unionByName(tagged_right)
        .withColumn("_right", F.last("_right", ignorenulls=True).over(w))
        .where(F.col("_side") == 1)
        .select(*by, on, *[F.col(f"_left.{c}").alias(c) for c in left_cols],
                *[F.col(f"_right.{v}").alias(v) for v in values])
    )
