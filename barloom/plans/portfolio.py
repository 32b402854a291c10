"""Multi-asset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.series import rounded, sdiv
from barloom.operators import portfolio as pa
from barloom.plans.base_sql import BARS, BENCH, RETURNS, aligned
from barloom.plans.registry import query
from barloom.plans.risk import closes, staged_closes
from barloom.session import stage
from barloom.sources.market import baskets, benchmark

N = None  # all returns enter the alignment


@query("pa_aligned_returns", f"WITH {RETURNS}{aligned(N)} SELECT basket, symbol, ts, round(ret, 8) AS ret FROM aligned")
def _(spark, sf):
    return rounded(pa.aligned_returns(staged_closes(spark, sf), baskets(spark, sf), N), 8)


@query("pa_alignment_report", f"""WITH {RETURNS}{aligned(N)}, o AS (SELECT basket, count(DISTINCT ts) AS observations FROM aligned GROUP BY basket),
  h AS (SELECT symbol, count(*) AS b FROM bars GROUP BY symbol)
  SELECT basket, symbol, coalesce(observations, 0) AS observations, CASE WHEN b IS NULL THEN 'no bars'
    WHEN b < 2 THEN 'too few bars for a return' WHEN observations IS NULL THEN 'no common dates in the basket' END AS reason,
    coalesce(observations, 0) >= 20 AND count(*) FILTER (b >= 2) OVER (PARTITION BY basket) >= 2 AS sufficient
  FROM mem LEFT JOIN h USING (symbol) LEFT JOIN o USING (basket)""")
def _(spark, sf):
    daily, members = staged_closes(spark, sf), baskets(spark, sf)
    return pa.alignment_report(pa.aligned_returns(daily, members, N), daily, members)


PAIRS = """pairs AS MATERIALIZED (SELECT x.basket, x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS corr, covar_samp(x.ret, y.ret) * 252 AS cov, count(*) AS n
  FROM aligned x JOIN aligned y USING (basket, ts) GROUP BY ALL)"""


@query("pa_correlation_covariance", f"WITH {RETURNS}{aligned(N)}, {PAIRS} SELECT basket, a, b, round(corr, 6) AS corr, round(cov, 6) AS cov, n FROM pairs")
def _(spark, sf):
    return rounded(pa.pair_statistics(pa.aligned_returns(staged_closes(spark, sf), baskets(spark, sf), N)))


BETA = """mkt AS (SELECT ts, ln(bench / lag(bench) OVER (ORDER BY ts)) AS m FROM bench),
  beta AS MATERIALIZED (SELECT symbol, CASE WHEN n >= 60 THEN beta END AS beta, CASE WHEN n >= 60 THEN c * c END AS r_squared, n FROM (
    SELECT symbol, regr_slope(ret, m) AS beta, corr(ret, m) AS c, count(*) AS n FROM rets JOIN mkt USING (ts)
    WHERE ret IS NOT NULL AND m IS NOT NULL GROUP BY symbol))"""


@query("pa_capm_beta", f"WITH {RETURNS}{BENCH}, {BETA} SELECT symbol, round(beta, 6) AS beta, round(r_squared, 6) AS r_squared, n FROM beta")
def _(spark, sf):
    daily = staged_closes(spark, sf)
    return rounded(pa.capm_beta(daily, benchmark(daily)))


@query("pa_attribution", f"""WITH {RETURNS}{BENCH}, {BETA}, p AS (SELECT symbol, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS a,
    (arg_max(bench, ts) / arg_min(bench, ts) - 1) * 100 AS b, date_diff('day', min(ts), max(ts)) AS days FROM bars JOIN bench USING (ts) GROUP BY symbol),
  q AS (SELECT p.*, coalesce(beta, 1) AS beta, (pow(1.04::DOUBLE, days / 365.25::DOUBLE) - 1) * 100 AS rf FROM p JOIN beta USING (symbol))
  SELECT symbol, days, round(rf, 6) AS risk_free_pct, round(a - rf, 6) AS total_excess_pct, round(beta * (b - rf), 6) AS systematic_pct,
    round(a - rf - beta * (b - rf), 6) AS selection_pct FROM q""")
def _(spark, sf):
    daily = staged_closes(spark, sf)
    bench = benchmark(daily)
    span = daily.join(bench, "ts").groupBy("symbol").agg(
        ((sdiv(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1) * 100).alias("a"),
        ((sdiv(F.max_by("bench", "ts"), F.min_by("bench", "ts")) - 1) * 100).alias("b"),
        F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("days"))
    both = span.join(pa.capm_beta(daily, bench).select("symbol", "beta"), "symbol")
    cols = pa.attribution(F.col("a"), F.col("b"), F.coalesce("beta", F.lit(1.0)), F.col("days"))
    return rounded(both.select("symbol", "days", *[c.alias(n) for n, c in cols.items()]))


@query("pa_diversification", f"""WITH {RETURNS}{aligned(N)}, w AS (SELECT basket, symbol, weight / sum(weight) OVER (PARTITION BY basket) AS w
    FROM (SELECT DISTINCT basket, symbol FROM aligned) JOIN mem USING (basket, symbol)), {PAIRS},
  v AS (SELECT p.basket, sqrt(sum(x.w * y.w * cov)) AS pv FROM pairs p JOIN w x ON p.basket = x.basket AND p.a = x.symbol JOIN w y ON p.basket = y.basket AND p.b = y.symbol GROUP BY 1),
  m AS (SELECT p.basket, sum(w * sqrt(cov)) AS wv FROM pairs p JOIN w ON p.basket = w.basket AND p.a = w.symbol WHERE p.a = p.b GROUP BY 1)
  SELECT basket, round(pv, 6) AS portfolio_vol, round(wv, 6) AS weighted_vol, round(wv - pv, 6) AS benefit, round(wv / pv, 6) AS ratio FROM v JOIN m USING (basket)""")
def _(spark, sf):
    members = baskets(spark, sf)
    return rounded(pa.diversification(pa.aligned_returns(staged_closes(spark, sf), members, N), members))


CANDS = f"""{PAIRS}, nm AS (SELECT DISTINCT basket, symbol FROM aligned),
  raw AS (SELECT basket, symbol, c AS candidate, CASE WHEN c = 0 THEN 1 ELSE -ln((('0x' || substr(md5(c || '|' || symbol), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) END AS e
    FROM nm, range(501) t(c)),
  cw AS MATERIALIZED (SELECT basket, symbol, candidate, e / sum(e) OVER (PARTITION BY basket, candidate) AS w FROM raw),
  mu AS (SELECT basket, symbol, avg(ret) * 252 AS mu FROM aligned GROUP BY ALL),
  er AS (SELECT basket, candidate, sum(w * mu) AS exp_return FROM cw JOIN mu USING (basket, symbol) GROUP BY ALL),
  va AS (SELECT x.basket, x.candidate, sqrt(greatest(sum(x.w * y.w * cov), 0)) AS vol FROM cw x JOIN pairs p ON x.basket = p.basket AND x.symbol = p.a
    JOIN cw y ON y.basket = p.basket AND y.symbol = p.b AND y.candidate = x.candidate GROUP BY ALL),
  scored AS MATERIALIZED (SELECT basket, candidate, exp_return, vol, (exp_return - 0.04) / nullif(vol, 0) AS sharpe FROM er JOIN va USING (basket, candidate))"""


def scored(spark, sf):
    data = stage(pa.aligned_returns(closes(spark, sf), baskets(spark, sf), N))
    return pa.score_candidates(data, pa.candidates(data.select("basket", "symbol").distinct()))


@query("pa_candidates", f"""WITH {RETURNS}{aligned(N)}, {CANDS} SELECT basket, candidate, round(exp_return, 6) AS exp_return, round(vol, 6) AS vol,
  round(sharpe, 6) AS sharpe FROM scored""")
def _(spark, sf):
    return rounded(scored(spark, sf))


@query("pa_best_portfolios", f"""WITH {RETURNS}{aligned(N)}, {CANDS}, pick AS (
    SELECT basket, 'min_variance' AS portfolio, arg_min(candidate, vol) AS candidate FROM scored GROUP BY basket
    UNION ALL SELECT basket, 'max_sharpe', arg_max(candidate, sharpe) FROM scored GROUP BY basket
    UNION ALL SELECT DISTINCT basket, 'equal_weight', 0 FROM scored)
  SELECT basket, candidate, portfolio, round(exp_return, 6) AS exp_return, round(vol, 6) AS vol, round(sharpe, 6) AS sharpe FROM pick JOIN scored USING (basket, candidate)""")
def _(spark, sf):
    return rounded(pa.best_candidates(stage(scored(spark, sf))))


@query("pa_frontier", f"""WITH {RETURNS}{aligned(N)}, {CANDS}, e AS (SELECT basket, arg_min(exp_return, vol) AS lo, max(exp_return) AS hi FROM scored GROUP BY basket)
  SELECT basket, least(floor((exp_return - lo) / (hi - lo) * 25), 24)::BIGINT AS point, arg_min(candidate, vol) AS candidate,
    round(arg_min(exp_return, vol), 6) AS exp_return, round(min(vol), 6) AS vol FROM scored JOIN e USING (basket) WHERE exp_return >= lo GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(pa.frontier(stage(scored(spark, sf))))


@query("pa_min_variance_short", f"""WITH RECURSIVE {RETURNS}{aligned(N)}, {PAIRS}, mu AS (SELECT basket, symbol, avg(ret) * 252 AS mu FROM aligned GROUP BY ALL),
  m0 AS MATERIALIZED (SELECT basket, a, row_number() OVER (PARTITION BY basket ORDER BY a) AS i, list_append(list(cov ORDER BY b), 1.0) AS r, count(*) AS n FROM pairs GROUP BY basket, a),
  g AS (SELECT basket, 0 AS k, a, i, r, n FROM m0 UNION ALL
    SELECT g.basket, g.k + 1, g.a, g.i, CASE WHEN g.i = g.k + 1 THEN list_transform(g.r, lambda x: x / g.r[g.k + 1]) ELSE list_transform(list_zip(g.r, p.r), lambda z: z[1] - g.r[g.k + 1] * z[2] / p.r[g.k + 1]) END, g.n
    FROM g JOIN g p ON p.basket = g.basket AND p.i = g.k + 1 WHERE g.k < g.n),
  x AS (SELECT basket, a AS symbol, r[n + 1] AS x FROM g WHERE k = n), t AS (SELECT basket, sum(x) AS t FROM x GROUP BY basket),
  e AS (SELECT basket, sum(x / t * mu) AS er, any_value(sqrt(1 / t)) AS vol FROM x JOIN t USING (basket) JOIN mu USING (basket, symbol) GROUP BY basket)
  SELECT basket, symbol, round(x / t, 6) AS weight, round(er, 6) AS exp_return, round(vol, 6) AS vol, round((er - 0.04) / vol, 6) AS sharpe, 'ok' AS status FROM x JOIN t USING (basket) JOIN e USING (basket)""")
def _(spark, sf):
    return rounded(pa.min_variance_short(stage(pa.aligned_returns(closes(spark, sf), baskets(spark, sf), N))))


@query("pa_momentum", f"WITH {BARS} SELECT symbol, count(*) AS bars, round(arg_max(close, ts) / arg_min(close, ts) - 1, 6) AS momentum FROM bars GROUP BY symbol")
def _(spark, sf):
    return rounded(pa.momentum(closes(spark, sf)))
