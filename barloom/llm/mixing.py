"""Mixing sources to target weights by Pfair scheduling.

A source with weight w has units of ``UNIT`` documents; its k-th unit (from 0) may not start before slot floor(k / w) and must be done
before slot ceil((k + 1) / w).  Taking, in every slot, the released unit with the earliest deadline keeps each
source within less than one unit of its weight at every point of the mix.

Exact weights need no table as long as the mix: they are written in digits.  A period of P slots gives each source the whole part
of P times its weight; the slots left over go to a further participant, the rest, and the slots of the rest are a mix of its own
of what remains of the weights, with a period of P again.  ``LEVELS`` such periods, each scheduled by its deadlines, place any number of units
in closed form.  The weights hold to within (m / P)^(LEVELS - 1) / P for m sources, a billionth for ten of them; P is ``PERIOD`` or ten times the
number of sources.  A level deviates by less than one unit and passes on less than a ninth more, so together by less than 2 * LEVELS units,
which is ``BLOCK`` documents: the mix deviates by less than one block from the target weights at every point.

Documents of a source are dealt to units in hash order.  Their numbers come from a count per (source, cell) with a running
sum over cells; cells are hash ranges whose number follows the square root of the row count, so that a source
with a third of all rows is numbered by thousands of tasks, each a small sort.

The mix goes on until every unit of every source has been used, repeating the units of sources
that end sooner, so no document is lost; ``copy`` counts the repeats.  Units are dealt to levels in order, not to slots, so a repeat may stand before
its first copy.

Any number of sources can be mixed; the levels are scheduled in one task, whose work grows with the square of their number (not with the documents).

Defined cases: a null source is a source of its own; rows without text count as any other; ties and repeated rows are
numbered in any order among themselves; an empty table gives no rows; a source without a positive weight in ``weights`` raises; extra
columns stay out of the way.
"""

from __future__ import annotations

from math import ceil, isqrt, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import aside, table, whole_row

#: Documents a block, by which the mix may deviate.
BLOCK = 16
#: Periods inside one another.
LEVELS = 4
#: Documents a unit, what a slot holds.
UNIT = BLOCK // (2 * LEVELS)
#: Slots a period at least; ten for every source if that is more.
PERIOD = 1000
#: Target weight of a source with n documents, before scaling: n to this power.
EVENNESS = 0.7


def _key(source: Column) -> Column:
    """The source, with null as a value of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _numbered(docs: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """``row, key, place`` (from 0 within the source, in hash order), and ``key, n`` per source."""
    cells = 2 ** ceil(log2(max(isqrt(rows), 1)))
    spread = docs.select(whole_row(), _key(F.col("source")).alias("key"), F.xxhash64("*").alias("h"))
    spread = spread.withColumn("cell", F.shiftrightunsigned("h", 64 - int(log2(cells))) if cells > 1 else F.lit(0).cast("long"))
    counted = spread.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = aside(counted.select("key", "cell", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    in_cell = Window.partitionBy("key", "cell").orderBy("h")
    numbered = spread.withColumn("k", F.row_number().over(in_cell) - 1).join(starts.drop("n"), ["key", "cell"])
    return numbered.select("row", "key", (F.col("start") + F.col("k")).alias("place")), starts.groupBy("key").agg(F.sum("n").alias("n"))


def targets(sizes: DataFrame, weights: dict[str | None, float] | None = None, evenness: float = EVENNESS) -> DataFrame:
    """One row, none without sources: ``sources``, an array by key of (key, n, units, weight), weights adding up to 1, and ``p``, the slots a period."""
    if weights is None:
        wanted = F.pow(F.col("n").cast("double"), F.lit(evenness))
    else:
        pairs = [x for s, w in weights.items() for x in (F.lit("null" if s is None else f"={s}"), F.lit(float(w)))]
        given = F.try_element_at(F.create_map(*pairs), F.col("key"))
        wanted = F.when(given > 0, given).otherwise(F.raise_error(F.concat(F.lit("no weight for the source "), F.col("key"))).cast("double"))
    one = sizes.select("key", "n", F.ceil(F.col("n") / UNIT).alias("units"), wanted.alias("wanted"))
    # one row a source: the list grows with the sources, not with the documents
    one = one.agg(F.sort_array(F.collect_list(F.struct("key", "n", "units", "wanted"))).alias("s")).where(F.size("s") > 0)
    total = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x["wanted"])
    weight = lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"), x["units"].alias("units"), (x["wanted"] / F.col("total")).alias("weight"))
    return one.select("s", total.alias("total"), F.greatest(F.lit(PERIOD), 10 * F.size("s")).alias("p")).select(F.transform("s", weight).alias("sources"), "p")


def _digits(left: Column, p: Column, last: bool) -> Column:
    """Whole slots of a period for each of the weights ``left`` (adding up to 1); in the last level all slots go, by largest remainders."""
    whole = F.transform(left, lambda x: F.floor(x * p + 1e-9).cast("int"))
    if not last:
        return whole
    spare = p - F.aggregate(whole, F.lit(0), lambda acc, x: acc + x)
    order = F.array_sort(F.transform(left, lambda x, i: F.struct((F.floor(x * p + 1e-9) - x * p).alias("short"), i.alias("i"))))
    up = F.transform(F.slice(order, 1, F.greatest(spare, F.lit(0))), lambda x: x["i"])
    return F.transform(whole, lambda x, i: x + F.array_contains(up, i).cast("int"))


def _schedule(shares: Column, p: Column) -> Column:
    """Who has each slot of a period, by position in ``shares``, which add up to p: earliest deadline first among the released.

    A fold over the slots; its state is how many units each participant has had.
    """
    def step(acc: Column, t: Column) -> Column:
        waiting = F.transform(shares, lambda s, i: F.when(s > 0, F.struct(
            F.ceil((F.get(acc["had"], i) + 1) * p / s).alias("deadline"), i.alias("i"),
            F.floor(F.get(acc["had"], i) * p / s).alias("release"))))
        best = F.array_min(F.filter(waiting, lambda w: w["release"] <= t))["i"]
        # a list of one, so that the lambdas below see a value instead of the expression
        return F.get(F.transform(F.array(best), lambda one: F.struct(
            F.transform(acc["had"], lambda had, i: F.when(i == one, had + 1).otherwise(had)).alias("had"),
            F.concat(acc["slots"], F.array(one)).alias("slots"))), F.lit(0))

    start = F.struct(F.transform(shares, lambda s: F.lit(0)).alias("had"), F.array().cast("array<int>").alias("slots"))
    return F.aggregate(F.sequence(F.lit(0), p - 1), start, step)["slots"]


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column, behind a generator: the optimizer would repeat the expression inside the lambdas that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def levels(sources: DataFrame) -> DataFrame:
    """A row per source: ``key, n, units, weight, p``; ``own`` and ``rest``: by level, the slots of the source and of the rest in a period."""
    row = sources.withColumn("left", F.transform("sources", lambda s: s["weight"]))
    for level in range(LEVELS):
        row = _once(row, "whole", _digits(F.col("left"), F.col("p"), level == LEVELS - 1))
        row = _once(row, "shares", F.concat("whole", F.array(F.col("p") - F.aggregate("whole", F.lit(0), lambda acc, x: acc + x))))
        row = _once(row, f"slots{level}", _schedule(F.col("shares"), F.col("p")))
        rest = F.greatest(F.element_at("shares", -1), F.lit(1))
        remains = F.transform("left", lambda x, i: F.greatest(x * F.col("p") - F.get("whole", i), F.lit(0.0)) / rest)
        row = aside(row.withColumn("left", remains).drop("whole", "shares"))
    each = row.select("*", F.posexplode("sources").alias("i", "s"))

    def places(i: Column) -> Column:
        of = lambda slots: F.filter(F.transform(slots, lambda x, t: F.when(x == i, t)), lambda t: t.isNotNull())
        return F.array(*[of(F.col(f"slots{level}")) for level in range(LEVELS)])

    return each.select("s.*", F.col("p").cast("long").alias("p"), places(F.col("i")).alias("own"), places(F.size("sources")).alias("rest"))


def _counts(slots: Column) -> Column:
    """Units of a source, by level, in the first ``slots`` slots of the mix."""
    p = F.col("p")

    def step(acc: Column, level: Column) -> Column:
        had = lambda name: F.floor(acc["slots"] / p) * F.size(F.get(name, level)) + F.size(
            F.filter(F.get(name, level), lambda t: t < acc["slots"] % p))
        return F.struct(had("rest").alias("slots"), F.concat(acc["counts"], F.array(had("own"))).alias("counts"))

    start = F.struct(slots.cast("long").alias("slots"), F.array().cast("array<long>").alias("counts"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step)["counts"]


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _slot(level: int, k: Column) -> Column:
    """The slot in the mix of a source's k-th unit of a level: from the innermost period outwards."""
    name = "own"
    for inside in range(level, -1, -1):
        places = F.get(name, F.lit(inside))
        size = F.greatest(F.size(places), F.lit(1))
        k = F.floor(k / size) * F.col("p") + F.get(places, (k % size).cast("int"))
        name = "rest"
    return k


def _ends(sources: DataFrame) -> Column:
    """The first slot after which all units of a source have been used, found by halving."""
    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2)
        enough = _total(_counts(middle)) >= F.col("units")
        return F.struct(F.when(enough, acc["low"]).otherwise(middle + 1).alias("low"), F.when(enough, middle).otherwise(acc["high"]).alias("high"))

    most = F.ceil((F.col("units") + 2 * LEVELS) / F.col("weight"))
    start = F.struct(F.lit(0).cast("long").alias("low"), most.alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(most + 1)).cast("int") + 1), start, halve)["high"]


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, evenness: float = EVENNESS) -> DataFrame:
    """``row, key, unit, copy, slot, seat``: where each document (and each repeat of it) stands in the mix.

    Order by (slot, seat) to read the mix.  ``weights`` maps sources to target weights; without it a source with n
    documents gets n to the power ``evenness``.
    """
    numbered, sizes = _numbered(docs, docs.count())
    planned = aside(levels(targets(sizes, weights, evenness)))
    end = planned.agg(F.max(_ends(planned)).alias("end")).first()["end"] or 0
    used = planned.withColumn("counts", _counts(F.lit(end))).withColumn("used", _total(F.col("counts")))
    placed = numbered.withColumns({"unit": F.floor(F.col("place") / UNIT), "seat": (F.col("place") % UNIT).cast("int")})
    placed = placed.join(F.broadcast(aside(used.select("key", "units", "used", "counts"))), "key")  # one row a source
    copies = F.sequence(F.lit(0).cast("long"), F.floor((F.col("used") - 1 - F.col("unit")) / F.col("units")))
    placed = placed.withColumn("copy", F.explode(copies))
    # LEVELS periods in all, and the slots of the rest once a source
    placed = placed.join(F.broadcast(planned.select("key", "p", "own", "rest")), "key")
    nth, slot = F.col("unit") + F.col("copy") * F.col("units"), F.lit(None).cast("long")
    before = [F.lit(0).cast("long")]
    for level in range(LEVELS):
        before.append(before[-1] + F.get("counts", F.lit(level)))
    for level in reversed(range(LEVELS)):
        slot = F.when(nth < before[level + 1], _slot(level, nth - before[level])).otherwise(slot)
    return placed.select("row", "key", "unit", "copy", slot.alias("slot"), "seat")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's places in the mix; no text moves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return mix(docs).select("row.doc_id", "row.source", "unit", "copy", "slot", "seat")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix, repeated where the mix repeats them."""
    return mix(docs).repartitionByRange("slot").sortWithinPartitions("slot", "seat").select("row.*")
