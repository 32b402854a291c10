"""Exponential smoothing  y[t] = (1 - a) * y[t-1] + a * x[t]  without a row loop.

With q = 1 - a and d the input of each step, the recurrence has the closed form
y[j] = q^j * sum(d[i] * q^-i, i <= j).  It is evaluated inside blocks short
enough for q^-j to stay finite; the end of the preceding block is carried over
with weight q^(j+1).  A block spans ~e^600 of decay, so anything older than one
block is far below double precision.  Two running windows do it all: no join,
no array of a whole series, and daily histories fit in a single block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import KEY, over_time, running

_DECAY = 600.0  # natural log of the largest scale factor used inside a block
_NEGLIGIBLE = 60.0  # e^-60 is far below double precision


@dataclass(frozen=True)
class Smooth:
    """One smoothed column.

    ``seed``: None starts at the first non-null value; n starts at the n-th
    non-null value with the mean of the first n.  ``positional`` counts every
    row instead of non-null rows and averages the non-null ones among them.
    ``min_count`` blanks the result until that many values were seen.  ``like`` names a column that is NULL on the same rows as ``x``:
    specs on like columns count and cut their steps together, which saves a sort.
    """

    out: str
    x: str
    alpha: float
    seed: int | None = None
    positional: bool = False
    min_count: int = 1
    like: str | None = None

    def pattern(self) -> tuple:
        """Specs of equal pattern take their steps on the same rows."""
        return self.like or self.x, self.seed, self.positional


def wilder(n: int) -> float:
    return 1.0 / n


def span(n: int) -> float:
    return 2.0 / (n + 1)


def _block_size(specs: Sequence[Smooth]) -> dict[float, int]:
    """Rows per block for every alpha; one shared size where that loses nothing."""
    rates = {s.alpha: -math.log1p(-s.alpha) for s in specs if s.alpha < 1.0}
    if not rates:
        return {}
    own = {a: max(2, int(_DECAY / r)) for a, r in rates.items()}
    shared = min(own.values())
    if shared * min(rates.values()) >= _NEGLIGIBLE:
        return {a: shared for a in rates}
    return own


def smooth(df: DataFrame, specs: Sequence[Smooth], key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """Add one column per spec; all specs share the shuffle and the sort."""
    w, cum = over_time(key, order), running(key, order)
    size = _block_size(specs)
    keep = df.columns

    same: dict[tuple, int] = {}  # pattern -> the first spec that has it
    lead = [same.setdefault(s.pattern(), i) for i, s in enumerate(specs)]

    step = df.withColumn("_rn", F.row_number().over(w) - 1)
    step = step.withColumns(
        {f"_n{i}": (F.col("_rn") + 1 if specs[i].positional else F.count(specs[i].x).over(cum)) for i in same.values()}
    )
    seeds = {}
    for i, s in enumerate(specs):
        if s.seed is not None:
            seeds[f"_s{i}"] = F.avg(F.when(F.col(f"_n{lead[i]}") <= s.seed, F.col(s.x))).over(cum)
    if seeds:
        step = step.withColumns(seeds)

    steps: dict[str, Column] = {}
    for i, s in enumerate(specs):
        x, n, start = F.col(s.x), F.col(f"_n{lead[i]}"), s.seed or 1
        at_start = (n == start) if s.positional else (n == start) & x.isNotNull()
        first = F.col(f"_s{i}") if s.seed is not None else x
        steps[f"_c{i}"] = F.when(at_start, first).when(n > start, s.alpha * x if s.alpha < 1.0 else x)
    step = step.withColumns(steps)
    # steps so far
    step = step.withColumns({f"_m{i}": F.count(f"_c{i}").over(cum) for i in same.values()})

    inputs: dict[str, Column] = {}
    place: dict[int, Column] = {}
    block: dict[int, str] = {}
    for i, s in enumerate(specs):
        if s.alpha < 1.0:
            b, m = size[s.alpha], F.greatest(F.col(f"_m{lead[i]}") - 1, F.lit(0))
            place[i] = m % b
            block[i] = f"_b{lead[i]}_{b}"
            inputs[block[i]] = m.cast("long") - place[i]
            inputs[f"_d{i}"] = F.coalesce(f"_c{i}", F.lit(0.0)) * F.pow(F.lit(1.0 - s.alpha), -place[i].cast("double"))
    step = step.withColumns(inputs)

    local: dict[str, Column] = {}
    for i, s in enumerate(specs):
        if s.alpha < 1.0:
            blocks = Window.partitionBy(*key, block[i]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            local[f"_l{i}"] = F.pow(F.lit(1.0 - s.alpha), place[i].cast("double")) * F.sum(f"_d{i}").over(blocks)
    if local:
        step = step.withColumns(local)

    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    result: dict[str, Column] = {}
    for i, s in enumerate(specs):
        if s.alpha >= 1.0:
            y = F.last(f"_c{i}", ignorenulls=True).over(cum)
        else:
            b = size[s.alpha]
            # of the block before: the value after its last step
            carry = F.last(F.when((place[i] == b - 1) & F.col(f"_c{i}").isNotNull(), F.struct(F.col(block[i]).alias("b"), F.col(f"_l{i}").alias("l"))),
                           ignorenulls=True).over(earlier)
            older = F.when(carry["b"] < F.col(block[i]), carry["l"])
            y = F.col(f"_l{i}") + F.pow(F.lit(1.0 - s.alpha), place[i].cast("double") + 1) * F.coalesce(older, F.lit(0.0))
        need = max(s.seed or 1, s.min_count)
        shown = F.col(f"_n{lead[i]}") >= need
        if s.seed is not None and not s.positional:
            shown = shown & F.col(s.x).isNotNull()
        result[s.out] = F.when(shown, y)
    return step.withColumns(result).select(*keep, *[s.out for s in specs])
