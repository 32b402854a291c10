"""Counting smaller and equal values inside groups of any size.

Equal values are merged first.  A group with many distinct values is then cut into ranges of about equal numbers of them, at splitters
taken from a quantile sketch of the group (sketches combine map-side and have a fixed size), so outliers and skewed values do not matter.  Each
range is counted on its own and range totals are summed up: no task sees more than one range of one group.  The splitters only spread the
work; the counts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values that one range holds, as long as a group has no more than MOST ranges of them.
ROWS = 10_000
MOST, STEP = 1024, 32


def splitters(seen: DataFrame, by: Sequence[str], value: str, rows: int = ROWS) -> DataFrame:
    """(by..., cuts) for every group of more than ``rows`` distinct values: ascending, at most MOST - 1 of them."""
    sizes = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    grid = F.percentile_approx(value, [i / MOST for i in range(1, MOST)], 10 * MOST)
    sketch = seen.join(sizes, list(by)).groupBy(*by, "_n").agg(grid.alias("_grid"))
    ranges = F.least(F.ceil(F.col("_n") / rows), F.lit(MOST))
    picked = F.transform(F.sequence(F.lit(1), ranges - 1), lambda i: F.col("_grid")[F.floor(i * MOST / ranges).cast("int") - 1])
    return sketch.select(*by, F.array_sort(F.array_distinct(picked)).alias("cuts"))


def range_of(value: Column, cuts: Column) -> Column:
    """How many cuts are below the value, in two steps of at most STEP comparisons each."""
    blocks = F.transform(F.sequence(F.lit(1), F.lit(MOST // STEP)), lambda i: F.get(cuts, (i * STEP).cast("int") - 1))
    whole = F.size(F.filter(blocks, lambda c: c < value)) * STEP
    return whole + F.size(F.filter(F.slice(cuts, whole + 1, STEP), lambda c: c < value))


def group_counts(df: DataFrame, by: Sequence[str], value: str, rows: int = ROWS) -> DataFrame:
    """(by..., value, less, equal, total) for every distinct non-null value of every group."""
    seen = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("equal"))
    cut = seen.join(splitters(seen, by, value, rows), list(by), "left")
    cut = cut.withColumn("_r", F.when(F.col("cuts").isNull(), 0).otherwise(range_of(F.col(value), F.col("cuts")))).drop("cuts")
    per_range = cut.groupBy(*by, "_r").agg(F.sum("equal").alias("_n"))
    below = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    per_range = per_range.select(*by, "_r", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.sum("_n").over(whole).alias("total"))
    inside = Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_inside", F.coalesce(F.sum("equal").over(inside), F.lit(0)))
    return local.join(per_range, [*by, "_r"]).select(*by, value, (F.col("_below") + F.col("_inside")).alias("less"), "equal", "total")
