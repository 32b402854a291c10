"""Window building blocks over a long table of bars.

Every series is identified by ``symbol`` and ordered by ``ts``.  A bar table
holds at most one row per (symbol, ts), so a symbol's rows are bounded by the
calendar (about 2,500 a decade for daily bars), however many ticks fed them;
the unbounded work is the tick aggregation, which combines map-side.
All helpers use one window specification, so Spark keeps one shuffle and one
sort for a whole stack of indicators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("symbol",)


def over_time(key: Sequence[str] = KEY, order: str = "ts"):
    return Window.partitionBy(*key).orderBy(order)


def running(key: Sequence[str] = KEY, order: str = "ts"):
    return over_time(key, order).rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int, key: Sequence[str] = KEY, order: str = "ts"):
    return over_time(key, order).rowsBetween(-(n - 1), 0)


def whole(key: Sequence[str] = KEY):
    return Window.partitionBy(*key)


def full(agg, x: Column, n: int, key: Sequence[str] = KEY) -> Column:
    """``agg(x)`` over the last n bars, NULL until n values are there."""
    w = trailing(n, key)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def prev(x: Column, k: int = 1, key: Sequence[str] = KEY) -> Column:
    return F.lag(x, k).over(over_time(key))


def ffill(x: Column, key: Sequence[str] = KEY, order: str = "ts") -> Column:
    return F.last(x, ignorenulls=True).over(running(key, order))


def bfill(x: Column, key: Sequence[str] = KEY, order: str = "ts") -> Column:
    return F.first(x, ignorenulls=True).over(over_time(key, order).rowsBetween(0, Window.unboundedFollowing))


#: Years after which a value no longer counts as the one before.
LONGEST_GAP = 150


def with_previous(df: DataFrame, value: str, name: str, order: str = "ts") -> DataFrame:
    """``name``: the value of the row before, for one long series without a key, in two levels.

    Every year looks back on its own; the first row of a year takes the last value of the nearest earlier year that has one, of which there
    is one row per year.  No task sees the whole series.
    """
    years = df.withColumn("_y", F.year(order))
    within = Window.partitionBy("_y").orderBy(order)
    inside = years.withColumns({name: F.lag(value).over(within), "_first": F.row_number().over(within) == 1})
    ends = years.groupBy("_y").agg(F.max_by(value, order).alias("_v")).withColumnRenamed("_y", "_from")
    carried = ends.select("_from", "_v", F.explode(F.sequence(F.col("_from") + 1, F.col("_from") + LONGEST_GAP)).alias("_y"))
    carried = carried.groupBy("_y").agg(F.max_by("_v", "_from").alias("_carried"))
    out = inside.join(carried, "_y", "left").withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(name)))
    return out.drop("_y", "_first", "_carried")


def sdiv(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def last_n(df: DataFrame, n: int, key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """The newest n rows of every series."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return df.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= n).drop("_pos")


def latest(df: DataFrame, key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """The newest row of every series (one hash aggregate, no sort)."""
    cols = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
        .select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])
    )


def bands(value: Column, steps: Sequence[tuple[str, float, str]], otherwise: str) -> Column:
    """Label a number by the first matching (op, bound, label); NULL stays NULL."""
    label = F.lit(otherwise)
    for op, bound, text in reversed(steps):
        test = {"<": value < bound, "<=": value <= bound, ">": value > bound, ">=": value >= bound}[op]
        label = F.when(test, F.lit(text)).otherwise(label)
    return F.when(value.isNotNull(), label)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column for a report."""
    return df.select(
        *[
            F.round(F.col(f.name), special.get(f.name, digits)).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
