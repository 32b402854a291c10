import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.asof import asof
from barloom.functions.rank import group_counts, range_of, splitters
from barloom.operators import alerts as al
from barloom.operators import clean as cl
from barloom.operators import fundamentals as fa
from barloom.operators import screen as sc
from barloom.operators import text as tx
from barloom.sources import payloads as pl


def test_group_counts_against_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot", 1.5) for _ in range(400)] + [("hot", rng.choice([-3.0, 0.0, 2.0, 1e9])) for _ in range(200)]
    rows += [("cold", rng.uniform(-1, 1)) for _ in range(100)] + [("one", 4.0)]
    got = {(r.g, r.v): (r.less, r.equal, r.total) for r in group_counts(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 16).collect()}
    for g, v in set(rows):
        same = [b for a, b in rows if a == g]
        assert got[(g, v)] == (sum(b < v for b in same), sum(b == v for b in same), len(same))


def test_one_outlier_does_not_crowd_a_range(spark):
    """2,000 close values and one far away: ranges of about 50 distinct values all the same, and exact counts."""
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(2000)] + [1e300, -1e300]
    rows = [("g", v) for v in values] + [("g", values[0])] * 3 + [("small", 1.0), ("small", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    seen = df.distinct()
    cuts = splitters(seen, ["g"], "v", 50)
    assert [r.g for r in cuts.collect()] == ["g"]  # a small group needs none
    sizes = [r["count"] for r in seen.join(cuts, "g").groupBy(range_of(F.col("v"), F.col("cuts"))).count().collect()]
    assert len(sizes) >= 38 and max(sizes) <= 100
    got = {(r.g, r.v): (r.less, r.equal, r.total) for r in group_counts(df, ["g"], "v", 50).collect()}
    ordered = sorted(v for g, v in rows if g == "g")
    assert all(got["g", v] == (ordered.index(v), ordered.count(v), len(ordered)) for v in set(ordered))
    assert got["small", 2.0] == (1, 1, 2)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 64, 1000, 1023])
def test_range_of_counts_cuts(spark, n):
    cuts = [float(2 * i) for i in range(n)]
    rows = [(cuts, float(v)) for v in (-1, 0, 1, n, 2 * n - 2, 2 * n - 1, 2 * n, 1e9)]
    got = spark.createDataFrame(rows, "cuts array<double>, v double").select("v", range_of(F.col("v"), F.col("cuts")).alias("r")).collect()
    assert all(r.r == sum(c < r.v for c in cuts) for r in got)


def test_percentile_excludes_the_target(spark):
    rows = [("A", "tech", "pe", 10.0), ("B", "tech", "pe", 20.0), ("C", "tech", "pe", 20.0), ("D", "tech", "pe", 30.0), ("E", "util", "pe", 5.0), ("F", "util", "pe", 6.0)]
    long = spark.createDataFrame(rows, "symbol string, sector string, metric string, value double")
    got = {r.symbol: r.percentile for r in sc.sector_percentiles(long).collect()}
    assert got == {"A": 0.0, "B": 50.0, "C": 50.0, "D": 100.0}  # utilities have too few peers


@pytest.mark.parametrize("p,text", [(85.0, "85th percentile"), (1.0, "1st percentile"), (12.0, "12th percentile"), (22.5, "22nd percentile"), (None, "N/A")])
def test_percentile_text(spark, p, text):
    assert spark.range(1).select(sc.percentile_text(F.lit(p).cast("double")).alias("t")).first().t == text


def test_wilson_prefers_evidence(spark):
    d = spark.createDataFrame([(3.0, 4.0), (6.0, 8.0)], "k double, n double").select(sc.wilson_pct(F.col("k"), F.col("n")).alias("w")).collect()
    assert d[0].w < d[1].w < 75


def test_screen_missing_is_undecided(spark):
    m = spark.createDataFrame([("A", "pe", 10.0), ("A", "rsi", None), ("B", "pe", 50.0), ("B", "rsi", 40.0)], "symbol string, metric string, value double")
    c = spark.createDataFrame([("s", "pe", "<", 20.0), ("s", "rsi", "<", 50.0)], "screen_id string, metric string, op string, threshold double")
    got = {r.symbol: (r.passed_all, r.status) for r in sc.run_screen(m, c).collect()}
    assert got == {"A": ("undecided", "insufficient_data"), "B": ("failed", "ok")}


def test_screen_answers_every_request(spark):
    m = spark.createDataFrame([("A", "pe", 10.0), ("A", "rsi", None), ("B", "pe", 50.0)], "symbol string, metric string, value double")
    c = spark.createDataFrame([("s", "pe", "<", 20.0)], "screen_id string, metric string, op string, threshold double")
    asked = spark.createDataFrame([(x, y) for x in ("s", "empty") for y in ("A", "B", "gone")], "screen_id string, symbol string")
    got = {(r.screen_id, r.symbol): (r.passed_all, r.status, r.missing) for r in sc.run_requests(m, c, asked).collect()}
    assert got == {("s", "A"): ("passed", "ok", ""), ("s", "B"): ("failed", "ok", ""), ("s", "gone"): ("undecided", "fetch_error", "pe"),
                   ("empty", "A"): (None, "ok", ""), ("empty", "B"): (None, "ok", ""), ("empty", "gone"): (None, "fetch_error", "")}


def test_rules_meet_what_satisfies_them(spark):
    """Random rules against random values through the interval index; equal values, extremes and unknown metrics included."""
    rng = random.Random(6)
    values = [(f"S{i}", m, rng.choice([None, float(rng.randrange(20)), rng.gauss(10, 5)])) for i in range(300) for m in ("a", "b")] + [("T", "a", 1e300)]
    rules = [(i, rng.choice(["a", "b", "c"]), rng.choice(["<", "<=", ">", ">="]), rng.choice([float(rng.randrange(20)), -99.0, 99.0, 1e300, None])) for i in range(60)]
    s = spark.createDataFrame(values, "symbol string, metric string, value double")
    r = spark.createDataFrame(rules, "rule int, metric string, op string, threshold double")
    test = {"<": lambda v, t: v < t, "<=": lambda v, t: v <= t, ">": lambda v, t: v > t, ">=": lambda v, t: v >= t}
    want = sorted((i, k) for i, m, op, t in rules for k, n, v in values if m == n and v is not None and t is not None and test[op](v, t))
    for rows in (10, 10_000):
        out = al.evaluate(s, r, rows)
        assert sorted((x.rule, x.symbol) for x in out.collect()) == want
    plan = al.evaluate(s, r, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan
    mine = spark.createDataFrame([("o", "a", "<", 10.0), ("p", "a", "<", 10.0)], "owner string, metric string, op string, threshold double")
    watch = spark.createDataFrame([("o", "S1"), ("o", "S1"), ("p", "S2"), ("q", "S3")], "owner string, symbol string")
    got = sorted((x.owner, x.symbol) for x in al.evaluate_watched(s, mine, watch).collect())
    below = {k for k, n, v in values if n == "a" and v is not None and v < 10}
    assert got == sorted((o, k) for o, k in (("o", "S1"), ("p", "S2")) if k in below)


def test_altman_by_hand(spark):
    cols = dict(symbol="A", sector=None, pretax_income=None, tax_provision=None, gross_profit=None, revenue=900.0, operating_income=None, net_income=None,
                total_assets=1000.0, equity=None, current_assets=400.0, current_liabilities=250.0, inventory=0.0, ebit=120.0, interest=None, free_cash_flow=None,
                market_cap=1500.0, total_debt=0.0, cash=0.0, depreciation=0.0, beta=None, retained_earnings=200.0, total_liabilities=600.0)
    schema = ", ".join(f"{k} {'string' if k in ('symbol', 'sector') else 'double'}" for k in cols)
    r = fa.ratios(spark.createDataFrame([tuple(cols.values())], schema)).first()
    assert r.altman_z == pytest.approx(1.2 * 0.15 + 1.4 * 0.2 + 3.3 * 0.12 + 0.6 * 2.5 + 0.999 * 0.9)
    assert r.altman_zone == "safe" and r.tax_rate == 0.21 and r.tax_fallback and r.beta_used == 1.0


def test_asof_takes_last_at_or_before(spark):
    left = spark.createDataFrame([("A", 5, "l1"), ("A", 1, "l2"), ("B", 9, "l3")], "k string, t int, name string")
    right = spark.createDataFrame([("A", 2, 20.0), ("A", 5, 50.0), ("A", 6, 60.0)], "k string, t int, v double")
    got = {r.name: r.v for r in asof(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {"l1": 50.0, "l2": None, "l3": None}


def test_cleaning_keeps_first_and_drops_impossible(spark):
    rows = [("A", "2024-01-01 00:00:00", 1.0, 2.0, 0.5, 1.5, 10.0, 1.4, 1), ("A", "2024-01-01 00:00:00", 9.0, 9.0, 9.0, 9.0, 1.0, 9.0, 2),
            ("A", "2024-01-02 00:00:00", 1.0, 0.4, 0.5, 1.0, 10.0, 1.0, 3), ("A", "2024-01-03 00:00:00", 1.0, 2.0, 0.5, None, 10.0, None, 4)]
    raw = spark.createDataFrame(rows, "symbol string, ts string, open double, high double, low double, close double, volume double, adj_close double, ingest_id long")
    out = cl.clean(raw).collect()
    assert [r.close for r in out] == [1.4]
    a = cl.audit(raw).first()
    assert (a.duplicates, a.invalid, a.gaps, a.is_clean) == (1, 2, 0, False)


def test_both_news_shapes(spark):
    nested = '{"id":"1","content":{"title":" T1 ","summary":"S1","provider":{"displayName":"P"},"pubDate":"2024-03-01T10:00:00Z","canonicalUrl":{"url":"u1"}}}'
    flat = '{"title":"T2","publisher":"Q","link":"u2","providerPublishTime":1709287200}'
    empty = '{"content":{"title":"  "}}'
    raw = spark.createDataFrame([("A", 1, nested), ("A", 2, flat), ("A", 3, empty), ("A", 4, "not json")], "symbol string, feed_pos int, body string")
    got = pl.articles(raw).orderBy("feed_pos").collect()
    assert [(r.title, r.url, r.provider) for r in got] == [("T1", "u1", "P"), ("T2", "u2", "Q")]
    assert got[0].published == got[1].published


def test_chart_takes_last_value_of_the_day(spark):
    day = 1_704_067_200_000
    points = ",".join(f"[{day + h * 3_600_000}, {100 + h * 0.01}]" for h in range(24))
    raw = spark.createDataFrame([("crypto:x", f'{{"prices":[{points},[{day + 86_400_000}, null]],"total_volumes":[[{day}, 5],[{day + 1}, 6]]}}')], "symbol string, body string")
    rows = pl.daily_from_chart(raw).collect()
    assert len(rows) == 1 and rows[0].close == pytest.approx(100.23) and rows[0].open == rows[0].close and rows[0].volume == 6.0


def test_finance_words_and_relevance(spark):
    texts = spark.createDataFrame([(1, "Apple beats earnings estimates"), (2, "Shares plunge on weak demand"), (3, "Company completes routine debt refinancing"), (4, "  ")], "id int, text string")
    got = {r.id: (r.score, r.label) for r in tx.score(texts, tx.finance_lexicon(spark), ["id"], "text").withColumn("label", tx.classify(F.col("score"))).collect()}
    assert got[1][1] == "positive" and got[2][1] == "negative" and got[3] == (0.0, "neutral") and got[4][0] is None
    row = spark.createDataFrame([("AAPL", "The Apple Inc.", "Why apple pie sells")], "s string, n string, t string")
    assert row.select(tx.is_relevant(F.col("t"), tx.company_tokens(F.col("s"), F.col("n"))).alias("r")).first().r
