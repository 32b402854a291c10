from pyspark.sql import functions as F

from barloom.operators import alerts as al
from barloom.operators import fundamentals as fa
from barloom.operators import thresholds as th

ANALYZED = ", ".join(["symbol string", "sector string", *[f"{c} double" for c in (
    "net_margin", "debt_to_equity", "roic_pct", "fcf_yield_pct", "interest_coverage", "pe_ratio", "peg_ratio", "beta", "current_ratio", "altman_z")]])
COMPANIES = [("A", "Energy", 0.12, 2.0, 12.0, 5.0, 4.0, 20.0, 1.0, 1.0, 1.2, 2.0), ("B", "Financials", 0.05, 3.0, 9.0, 3.0, 2.0, 12.0, 3.0, 2.0, 0.5, 1.0),
             ("C", None, 0.30, None, 30.0, None, None, 60.0, None, 0.5, 3.0, None)]


def tables(spark):
    users = spark.createDataFrame([(i,) for i in range(8)], "user_id long")
    overrides = spark.createDataFrame(
        [(1, "min_net_margin", 0.2), (2, "min_net_margin", 0.2), (2, "max_beta", 0.7), (3, "max_beta", 99.0), (4, "max_beta", 1.5), (5, "altman_grey_zone", 1.0), (6, "no such key", 1.0)],
        "user_id long, key string, value double")
    removed = spark.createDataFrame([(7, "Energy"), (1, "no such sector")], "user_id long, sector string")
    rows = spark.createDataFrame([(1, "Energy", 5.0, 50.0), (2, "Energy", 50.0, 5.0), (3, " ", 1.0, 2.0)], "user_id long, sector string, lo double, hi double")
    return users, overrides, removed, rows


def test_users_without_effective_edits_are_one_class(spark):
    members, classes = th.user_classes(*tables(spark))
    got = {r.user_id: r.class_id for r in members.collect()}
    assert len(got) == 8 and got[0] == got[3] == got[4] == got[6]  # out of bounds, equal to the default, unknown
    assert len({got[u] for u in (0, 1, 2, 5, 7)}) == 5 == classes.count()
    by = {r.class_id: r for r in classes.collect()}
    assert by[got[1]].th_min_net_margin == 0.2 and by[got[1]].th_bands["Energy"] == (5.0, 50.0) and by[got[2]].th_bands["Energy"] == (6.0, 22.0)
    assert "Energy" not in by[got[7]].th_bands and by[got[0]].th_max_beta == 1.5


def test_scorecard_by_user_equals_one_user_at_a_time(spark):
    users, overrides, removed, rows = tables(spark)
    companies = spark.createDataFrame(COMPANIES, ANALYZED)
    members, classes = th.user_classes(users, overrides, removed, rows)
    follows = users.withColumn("symbol", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))))
    out = fa.scorecard_by_user(companies, follows, members, classes)
    got = {(r.user_id, r.symbol): (r.green_flags, r.total_checks, r.score_pct, r.alignment, r.altman_zone) for r in out.collect()}
    assert len(got) == 24
    values = {(r.user_id, r.key): r.value for r in th.effective(users, overrides).collect()}
    bands = {}
    for r in th.sector_pe(users, removed, rows).collect():
        bands.setdefault(r.user_id, {})[r.sector] = (r.lo, r.hi)
    for u in range(8):
        limits = {k: F.lit(values[u, k]) for k, *_ in th.EDITABLE}
        table = F.create_map(*[x for s, (lo, hi) in bands[u].items() for x in (F.lit(s), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])
        one = fa.scorecard(companies, limits, table)
        for r in one.withColumn("zone", fa.altman_zone(F.col("altman_z"), limits["altman_safe_zone"], limits["altman_grey_zone"])).collect():
            assert got[u, r.symbol] == (r.green_flags, r.total_checks, r.score_pct, r.alignment, r.zone)
    shipped = {r.symbol: r.score_pct for r in fa.scorecard(companies).collect()}
    assert all(got[0, s][2] == shipped[s] for s in shipped) and got[1, "A"][2] != shipped["A"]
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


def test_default_threshold_follows_the_distress_zone(spark):
    members, classes = th.user_classes(*tables(spark))
    both = members.join(classes, "class_id").select("user_id", al.default_threshold(F.lit("altman_z"), F.col("th_altman_grey_zone")).alias("t"))
    assert {r.user_id: r.t for r in both.collect()}[5] == 1.0


def test_sector_bands_are_reported(spark):
    users, overrides, removed, rows = tables(spark)
    got = {r.user_id: r.problems for r in th.problems(th.by_user(th.effective(users, overrides)), rows).collect()}
    assert got[2] == "sector Energy: P/E band low must be below high" and got[1] == "" and got[3] == ""


def test_effective_and_wide_with_repeated_and_null_users(spark):
    users = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "user_id long")
    rows = [(1, "min_net_margin", 0.2), (2, "max_beta", 99.0), (2, "min_roic_pct", None), (2, None, 1.0), (None, "max_beta", 0.5), (4, "max_beta", 0.5), (3, "max_beta", 0.5), (3, "max_beta", 0.5)]
    values = th.effective(users, spark.createDataFrame(rows, "user_id long, key string, value double"))
    assert values.columns == ["user_id", "key", "value", "overridden"]
    defaults = {k: d for k, d, *_ in th.EDITABLE}
    got = sorted(((r.user_id or 0, r.key, r.value, r.overridden) for r in values.collect()))
    want = [(u, k, d, False) for u in (0, 1, 1, 2, 3) for k, d in defaults.items() if (u, k) not in ((1, "min_net_margin"), (3, "max_beta"))]
    assert got == sorted(want + [(1, "min_net_margin", 0.2, True)] * 2 + [(3, "max_beta", 0.5, True)] * 2)
    wide = {r.user_id: r.asDict() for r in th.by_user(values).collect()}
    assert len(wide) == 4 and wide[1] == {"user_id": 1, **defaults, "min_net_margin": 0.2} and wide[None] == {"user_id": None, **defaults}


def test_thresholds_are_spelled_out_behind_the_shuffle_of_users(spark):
    users, overrides, _, rows = tables(spark)
    plan = th.problems(th.by_user(th.effective(users, overrides)), rows)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    spelled = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    # no task before the shuffle holds all thresholds of its users, and no aggregation is by user and key
    assert any("Exchange hashpartitioning(user_id" in line for line in lines[spelled:])
    assert not any("Aggregate(keys=[user_id" in line and ", key#" in line.split("]")[0] for line in lines)
