"""Scores that leave out what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.series import sdiv


def clamp(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def linear(value: Column, zero_at: Column | float, full_at: Column | float) -> Column:
    """0..100, straight between the value scoring 0 and the value scoring 100, in either direction."""
    lo = zero_at if isinstance(zero_at, Column) else F.lit(float(zero_at))
    hi = full_at if isinstance(full_at, Column) else F.lit(float(full_at))
    return clamp(sdiv(value - lo, hi - lo) * 100, 0.0, 100.0)


def ideal(value: Column, best: float) -> Column:
    """100 at the ideal, falling with relative distance on both sides."""
    return clamp(100 * (1 - F.abs(value - best) / abs(best)), 0.0, 100.0)


def weighted(parts: Sequence[tuple[Column, float]], empty: float | None = None) -> Column:
    """Weighted mean over the parts that are not NULL."""
    num = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    den = present_weight(parts)
    mean = sdiv(num, den)
    return mean if empty is None else F.coalesce(mean, F.lit(float(empty)))


def present_weight(parts: Sequence[tuple[Column, float]]) -> Column:
    total: Column = F.lit(0.0)
    for s, w in parts:
        total = total + F.when(s.isNotNull(), F.lit(float(w))).otherwise(0.0)
    return total


def mean_of(parts: Sequence[Column]) -> Column:
    return weighted([(p, 1.0) for p in parts])


def names_where(tests: Sequence[tuple[Column, str]]) -> Column:
    """The names whose test holds, joined in order."""
    return F.concat_ws(", ", *[F.when(t, F.lit(n)) for t, n in tests])


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """value op threshold with the operator held as data; NULL when the value is missing."""
    return (
        F.when(op == ">", value > threshold).when(op == "<", value < threshold)
        .when(op == ">=", value >= threshold).when(op == "<=", value <= threshold)
    )
