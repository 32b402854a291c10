"""Per-user thresholds: shipped defaults overlaid with the overrides that are within bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import params as P

# --- fixed values: key, default, minimum, maximum ---
EDITABLE = (
    ("min_net_margin", 0.10, 0.0, 1.0), ("min_roic_pct", 10.0, 0.0, 100.0), ("min_fcf_yield_pct", 4.0, 0.0, 50.0),
    ("max_debt_to_equity", 2.5, 0.0, 20.0), ("financials_max_debt_to_equity", 4.0, 0.0, 30.0), ("min_current_ratio", 1.0, 0.0, 10.0),
    ("min_interest_coverage", 3.0, 0.0, 50.0), ("pe_range_low", 10.0, 0.0, 200.0), ("pe_range_high", 45.0, 0.0, 500.0),
    ("peg_range_low", 0.0, 0.0, 20.0), ("peg_range_high", 2.5, 0.0, 20.0), ("max_beta", 1.5, 0.0, 10.0),
    ("high_alignment_pct", 75.0, 0.0, 100.0), ("moderate_alignment_pct", 40.0, 0.0, 100.0),
    ("altman_safe_zone", 2.99, 0.0, 20.0), ("altman_grey_zone", 1.81, 0.0, 20.0), ("vix_high_risk_threshold", 25.0, 0.0, 100.0),
)
PAIRS = (
    ("pe_range_low", "pe_range_high", "P/E band low must be below high"),
    ("peg_range_low", "peg_range_high", "PEG band low must be below high"),
    ("altman_grey_zone", "altman_safe_zone", "Altman distress zone must be below the safe zone"),
    ("moderate_alignment_pct", "high_alignment_pct", "moderate alignment must be below high alignment"),
)


def effective(users: DataFrame, overrides: DataFrame) -> DataFrame:
    """(user_id, key, value, overridden); overrides(user_id, key, value) outside their bounds are ignored.

    Users meet their overrides as one row each, dealt by user; thresholds are spelled out only behind that.
    """
    specs = {k: F.struct(F.lit(k).alias("key"), F.lit(d).alias("default"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(1 << i).alias("bit")) for i, (k, d, lo, hi) in enumerate(EDITABLE)}
    spec = F.create_map(*[x for k, v in specs.items() for x in (F.lit(k), v)])[F.col("key")]
    spread = users.select("user_id").repartition("user_id")
    given = overrides.select("user_id", F.col("value").alias("_v"), spec.alias("s")).where(F.col("s").isNotNull()).select("user_id", "_v", "s.*").repartition("user_id")
    ok = F.coalesce(F.col("_v").between(F.col("lo"), F.col("hi")), F.lit(False))
    own = spread.join(given, "user_id").select("user_id", "key", F.when(ok, F.col("_v")).otherwise(F.col("default")).alias("value"), ok.alias("overridden"))
    bits = given.groupBy("user_id").agg(F.bit_or("bit").alias("bits"))
    rest = F.filter(F.array(*specs.values()), lambda s: s["bit"].bitwiseAND(F.coalesce("bits", F.lit(0))) == 0)
    shipped = spread.join(bits, "user_id", "left").select("user_id", F.explode(rest).alias("s"))
    return shipped.select("user_id", "s.key", F.col("s.default").alias("value"), F.lit(False).alias("overridden")).union(own)


def by_user(values: DataFrame) -> DataFrame:
    """One row per user with one column per threshold, in one aggregation that starts where a user's rows are."""
    return values.groupBy("user_id").agg(*[F.first(F.when(F.col("key") == k, F.col("value")), ignorenulls=True).alias(k) for k, *_ in EDITABLE])


def problems(wide: DataFrame, sector_rows: DataFrame | None = None) -> DataFrame:
    """Ordered pairs that are out of order, per user ('' when none), then the user's own sector bands that are, by name."""
    texts = [F.when(F.col(a) >= F.col(b), F.lit(t)) for a, b, t in PAIRS]
    if sector_rows is not None:
        empty = sector_rows.where(F.coalesce(F.trim("sector") != "", F.lit(False)) & (F.col("hi") <= F.col("lo")))
        named = F.concat(F.lit("sector "), F.col("sector"), F.lit(": P/E band low must be below high"))
        # at most one row per sector and user
        own = empty.repartition("user_id").groupBy("user_id").agg(F.array_sort(F.collect_set(named)).alias("_sectors"))
        wide = wide.join(own, "user_id", "left")
        texts.append(F.coalesce("_sectors", F.array().cast("array<string>")))
    return wide.select("user_id", F.concat_ws("; ", *texts).alias("problems"))


def valid_sector_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.trim("sector") != "", F.lit(False)) & (F.col("lo") >= 0) & (F.col("hi") > F.col("lo")))


def sector_pe(users: DataFrame, removed: DataFrame, overrides: DataFrame) -> DataFrame:
    """(user_id, sector, lo, hi): shipped rows minus the removed ones, replaced or extended by valid overrides."""
    table = F.explode(F.array(*[F.struct(F.lit(s).alias("sector"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for s, (lo, hi) in P.SECTOR_PE.items()]))
    shipped = users.select("user_id", table.alias("s")).select("user_id", "s.*").join(removed, ["user_id", "sector"], "left_anti")
    own = valid_sector_rows(overrides).select("user_id", "sector", "lo", "hi")
    return shipped.join(own, ["user_id", "sector"], "left_anti").unionByName(own)


# -- classes of users ----------------------------------------------------------------------------------------------------

BAND = "struct<lo:double,hi:double>"


def user_classes(users: DataFrame, overrides: DataFrame, removed: DataFrame, sector_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users of equal thresholds as one class: members(user_id, class_id) and classes(class_id, th_<key>..., th_bands).

    Only edits that take effect make a difference, so everybody without one is in the same class.  A user's edits are a row of their own before users
    are compared; thresholds are spelled out once per class, however many users it has.
    """
    specs = {k: (d, lo, hi) for k, d, lo, hi in EDITABLE}
    bound = lambda i: F.create_map(*[F.lit(x) for k, v in specs.items() for x in (k, v[i])])[F.col("key")]
    valid = overrides.where(F.col("value").between(bound(1), bound(2)) & (F.col("value") != bound(0)))
    own = valid.groupBy("user_id").agg(F.array_sort(F.collect_set(F.struct("key", "value"))).alias("own"))
    gone = removed.where(F.col("sector").isin(*P.SECTOR_PE)).groupBy("user_id").agg(F.array_sort(F.collect_set("sector")).alias("gone"))
    rows = valid_sector_rows(sector_rows).groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.struct("sector", F.struct(F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")).alias("band")))).alias("rows"))
    edits = users.select("user_id").join(own, "user_id", "left").join(gone, "user_id", "left").join(rows, "user_id", "left")
    edits = edits.withColumn("class_id", F.sha2(F.to_json(F.struct("own", "gone", "rows")), 256))
    members = edits.select("user_id", "class_id")
    classes = edits.groupBy("class_id").agg(F.first("own").alias("own"), F.first("gone").alias("gone"), F.first("rows").alias("rows"))
    values = {f"th_{k}": F.coalesce(F.map_from_entries("own")[k], F.lit(d)) for k, (d, _, _) in specs.items()}
    shipped = F.create_map(*[x for s, (lo, hi) in P.SECTOR_PE.items() for x in (F.lit(s), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])
    mine = F.coalesce(F.map_from_entries("rows"), F.create_map().cast(f"map<string,{BAND}>"))
    kept = F.map_filter(shipped, lambda k, _: ~F.coalesce(F.array_contains("gone", k), F.lit(False)) & ~F.map_contains_key(mine, k))
    return members, classes.select("class_id", *[v.alias(k) for k, v in values.items()], F.map_concat(kept, mine).alias("th_bands"))


def shipped() -> dict[str, Column]:
    """The thresholds as they ship."""
    return {k: F.lit(d) for k, d, _, _ in EDITABLE}


def of_class() -> dict[str, Column]:
    """The thresholds of the class that a row has been joined to."""
    return {k: F.col(f"th_{k}") for k, *_ in EDITABLE}


def for_followers(rows: DataFrame, follows: DataFrame, members: DataFrame, classes: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``score(rows with the thresholds of a class)`` for every user and symbol of follows(user_id, symbol).

    A symbol is scored once for every class of users that follows it; users meet the result by (class, symbol).
    """
    linked = follows.select("user_id", "symbol").distinct().join(members, "user_id")
    wanted = linked.select("class_id", "symbol").distinct()
    scored = score(wanted.join(rows, "symbol").join(classes, "class_id"))
    return linked.join(scored.drop(*[f"th_{k}" for k, *_ in EDITABLE], "th_bands"), ["class_id", "symbol"])
