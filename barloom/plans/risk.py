"""Risk queries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from barloom.functions.series import rounded
from barloom.operators import risk as rk
from barloom.plans.base_sql import BARS, RETURNS, full
from barloom.plans.registry import query
from barloom.sources.market import bars_daily
from barloom.sources.bars import bars
from barloom.session import stage
from barloom.sources.market import event_ticks


def closes(spark, sf, start=None, end=None):
    return bars_daily(spark, sf, start, end).select("symbol", "ts", "close")


def staged_closes(spark, sf, start=None, end=None):
    """The closes written once, for queries that read them from several branches."""
    return stage(closes(spark, sf, start, end))


@query("risk_log_returns", f"WITH {RETURNS} SELECT symbol, ts, round(ret, 8) AS ret FROM rets")
def _(spark, sf):
    return rounded(rk.log_returns(closes(spark, sf)).drop("close"), 8)


@query("risk_rolling_volatility", f"""WITH {RETURNS} SELECT symbol, ts, round({full('stddev_samp', 'ret', 21)} * sqrt(252), 6) AS rolling_vol FROM rets""")
def _(spark, sf):
    df = rk.log_returns(closes(spark, sf))
    return rounded(df.select("symbol", "ts", rk.rolling_vol(21).alias("rolling_vol")))


PERF = """perf AS (SELECT symbol, n_returns, CASE WHEN n_returns >= 2 THEN m * 252 END AS ann_return,
    CASE WHEN n_returns >= 2 THEN s * sqrt(252) END AS ann_vol, (m * 252 - 0.04) / nullif(s * sqrt(252), 0) AS sharpe,
    CASE WHEN n_returns >= 2 THEN d * sqrt(252) END AS downside_dev, (m * 252 - 0.04) / nullif(d * sqrt(252), 0) AS sortino
  FROM (SELECT symbol, count(ret) AS n_returns, avg(ret) AS m, stddev_samp(ret) AS s,
               sqrt(avg(least(ret, 0) * least(ret, 0)) FILTER (ret IS NOT NULL)) AS d FROM rets GROUP BY symbol))"""


@query("risk_performance", f"""WITH {RETURNS}, {PERF} SELECT symbol, n_returns, round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol,
  round(sharpe, 6) AS sharpe, round(downside_dev, 6) AS downside_dev, round(sortino, 6) AS sortino,
  CASE WHEN sharpe < 0 THEN 'poor' WHEN sharpe < 1 THEN 'sub-optimal' WHEN sharpe < 2 THEN 'good' WHEN sharpe < 3 THEN 'very good'
       WHEN sharpe IS NOT NULL THEN 'exceptional' END AS sharpe_band FROM perf""")
def _(spark, sf):
    out = rk.performance(closes(spark, sf))
    return rounded(out.withColumn("sharpe_band", rk.sharpe_band(F.col("sharpe"))))


Z95 = NormalDist().inv_cdf(0.05)


def tail_sql(conf: float, n: int) -> str:
    z = NormalDist().inv_cdf(1.0 - conf)
    return f"""rec AS MATERIALIZED (SELECT symbol, ret FROM rets QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= {n}),
  cut AS (SELECT symbol, quantile_cont(ret, {1.0 - conf!r}::DOUBLE) AS q, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM rec GROUP BY symbol),
  tail AS MATERIALIZED (SELECT symbol, n AS observations, CASE WHEN n >= 20 THEN q END AS hist_var,
    CASE WHEN n >= 20 THEN m + {z!r}::DOUBLE * s END AS param_var,
    CASE WHEN n >= 20 THEN (SELECT avg(ret) FROM rec WHERE rec.symbol = cut.symbol AND ret <= q) END AS expected_shortfall FROM cut)"""


@query("risk_tail_95", f"""WITH {RETURNS}, {tail_sql(0.95, 252)} SELECT symbol, observations, round(hist_var, 8) AS hist_var,
  round(param_var, 8) AS param_var, round(expected_shortfall, 8) AS expected_shortfall,
  format('Beyond the 95% VaR cutoff of {{:.2f}}% the average loss is {{:.2f}}%, {{:.2f}} points worse',
         hist_var * 100, expected_shortfall * 100, abs(expected_shortfall - hist_var) * 100) AS sentence FROM tail""")
def _(spark, sf):
    out = rk.tail_risk(closes(spark, sf))
    return rounded(out.withColumn("sentence", rk.tail_sentence(F.col("hist_var"), F.col("expected_shortfall"))), 8)


@query("risk_tail_99_full", f"""WITH {RETURNS}, {tail_sql(0.99, 10**9)} SELECT symbol, observations, round(hist_var, 8) AS hist_var,
  round(param_var, 8) AS param_var, round(expected_shortfall, 8) AS expected_shortfall FROM tail""")
def _(spark, sf):
    return rounded(rk.tail_risk(closes(spark, sf), 0.99, None), 8)


def drawdown_sql(src: str, price: str = "close", key: str = "symbol", name: str = "mdd") -> str:
    return f"""{name}_d AS MATERIALIZED (SELECT *, ({price} - peak) / peak AS drawdown FROM (
    SELECT *, max({price}) OVER (PARTITION BY {key} ORDER BY ts) AS peak FROM {src} WHERE {price} IS NOT NULL)),
  {name}_t AS MATERIALIZED (SELECT {key}, drawdown AS max_drawdown, peak AS peak_price, ts AS trough_ts, {price} AS trough_price FROM {name}_d
    QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY drawdown, ts) = 1),
  {name}_r AS (SELECT {key}, any_value(max_drawdown) AS max_drawdown, max(ts) FILTER (ts <= trough_ts AND {price} = peak_price) AS peak_ts,
    any_value(peak_price) AS peak_price, any_value(trough_ts) AS trough_ts, any_value(trough_price) AS trough_price,
    min(ts) FILTER (ts >= trough_ts AND {price} >= peak_price) AS recovery_ts FROM {name}_d JOIN {name}_t USING ({key}) GROUP BY {key}),
  {name} AS MATERIALIZED (SELECT r.*, recovery_ts IS NOT NULL AS recovered, CASE WHEN recovery_ts IS NOT NULL THEN
    (SELECT count(*) FROM {name}_d d WHERE d.{key} = r.{key} AND d.ts > r.trough_ts AND d.ts <= r.recovery_ts) END AS recovery_days FROM {name}_r r)"""


MDD = drawdown_sql("bars")


@query("risk_drawdown_series", f"""WITH {BARS} SELECT symbol, ts, round(peak, 6) AS peak, round((close - peak) / peak, 8) AS drawdown
  FROM (SELECT symbol, ts, close, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS peak FROM bars)""")
def _(spark, sf):
    return rounded(rk.with_drawdown(closes(spark, sf)).drop("close"), 6, drawdown=8)


@query("risk_max_drawdown", f"""WITH {BARS}, {MDD} SELECT symbol, round(max_drawdown, 8) AS max_drawdown, peak_ts, round(peak_price, 6) AS peak_price,
  trough_ts, round(trough_price, 6) AS trough_price, recovered, recovery_ts, recovery_days FROM mdd""")
def _(spark, sf):
    return rounded(rk.max_drawdown(closes(spark, sf)), 6, max_drawdown=8)


METRICS = f"""{PERF}, {tail_sql(0.95, 252)}, {MDD},
  vol AS (SELECT symbol, arg_max(v, ts) AS rolling_vol FROM (SELECT symbol, ts, {full('stddev_samp', 'ret', 21)} * sqrt(252) AS v FROM rets)
          WHERE v IS NOT NULL GROUP BY symbol),
  metrics AS MATERIALIZED (SELECT symbol, c.bars, c.last_close, n_returns, ann_return, ann_vol, sharpe, sortino, downside_dev, hist_var, param_var,
    expected_shortfall, max_drawdown, recovered, recovery_days, rolling_vol, ann_return / nullif(abs(max_drawdown), 0) AS calmar
    FROM perf JOIN tail USING (symbol) JOIN mdd USING (symbol) LEFT JOIN vol USING (symbol)
    JOIN (SELECT symbol, count(*) AS bars, arg_max(close, ts) AS last_close FROM bars GROUP BY symbol) c USING (symbol))"""


@query("risk_metrics", f"""WITH {RETURNS}, {METRICS} SELECT symbol, bars, round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol,
  round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(hist_var, 6) AS hist_var, round(expected_shortfall, 6) AS expected_shortfall,
  round(max_drawdown, 6) AS max_drawdown, round(rolling_vol, 6) AS rolling_vol, round(calmar, 6) AS calmar,
  CASE WHEN calmar < 0 THEN 'poor' WHEN calmar < 1 THEN 'sub-optimal' WHEN calmar < 3 THEN 'good' WHEN calmar < 5 THEN 'very good'
       WHEN calmar IS NOT NULL THEN 'excellent' END AS calmar_band FROM metrics""")
def _(spark, sf):
    out = rk.risk_metrics(closes(spark, sf)).withColumn("calmar_band", rk.calmar_band(F.col("calmar")))
    return rounded(out.select("symbol", "bars", "ann_return", "ann_vol", "sharpe", "sortino", "hist_var",
                              "expected_shortfall", "max_drawdown", "rolling_vol", "calmar", "calmar_band"))


@query("risk_hurst", f"""WITH {RETURNS}, x AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
    count(*) OVER (PARTITION BY symbol) AS n FROM rets WHERE ret IS NOT NULL),
  s AS (SELECT DISTINCT symbol, n, CASE k WHEN 0 THEN 10 WHEN 19 THEN n // 2 ELSE
      floor(pow(10::DOUBLE, 1 + k * (log10((n // 2)::DOUBLE) - 1) / 19))::BIGINT END AS size
    FROM (SELECT DISTINCT symbol, n FROM x WHERE n // 2 >= 10), range(20) t(k)),
  c AS MATERIALIZED (SELECT x.symbol, size, i // size AS chunk, i, ret FROM x JOIN s USING (symbol) WHERE i // size < x.n // size),
  d AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol, size, chunk) AS dev FROM c),
  k AS (SELECT *, sum(dev) OVER (PARTITION BY symbol, size, chunk ORDER BY i) AS walk FROM d),
  rs AS (SELECT symbol, size, avg(r / sd) AS rs FROM (SELECT symbol, size, chunk, max(walk) - min(walk) AS r, stddev_pop(ret) AS sd
         FROM k GROUP BY ALL) WHERE sd > 0 GROUP BY ALL),
  f AS (SELECT symbol, CASE WHEN count(*) >= 2 THEN regr_slope(ln(rs), ln(size)) END AS hurst, count(*) AS sizes FROM rs GROUP BY symbol)
  SELECT symbol, round(hurst, 6) AS hurst, sizes, CASE WHEN hurst < 0.45 THEN 'mean-reverting' WHEN hurst > 0.55 THEN 'trending'
    WHEN hurst IS NOT NULL THEN 'random walk' END AS regime FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN f USING (symbol)""")
def _(spark, sf):
    return rounded(rk.hurst(closes(spark, sf)))


@query("risk_histogram", f"""WITH {RETURNS}, {tail_sql(0.95, 252)}, lim AS (SELECT symbol, min(ret) AS lo, max(ret) AS hi FROM rec GROUP BY symbol)
  SELECT symbol, least(floor((ret - lo) / (hi - lo) * 40), 39)::BIGINT AS bin,
    round(any_value(lo) + any_value(hi - lo) / 40 * least(floor((ret - lo) / (hi - lo) * 40), 39)::BIGINT, 6) AS bin_low, count(*) AS n,
    round(any_value(hist_var), 6) AS hist_var, round(any_value(expected_shortfall), 6) AS expected_shortfall
  FROM rec JOIN lim USING (symbol) JOIN tail USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(rk.return_histogram(closes(spark, sf)))


@query("risk_position_sizing", f"""WITH {BARS}, eb AS (SELECT date_trunc('day', ts) AS d, sqrt(value) AS v, ts, event_id FROM events WHERE event_type = 'error'),
  fear AS (SELECT arg_max(100 + 0.5 * v, epoch_us(ts) % 86400000000 * 67108864 + event_id % 67108864) AS c FROM eb WHERE d = (SELECT max(d) FROM eb)),
  r AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars),
  s AS (SELECT symbol, count(r) AS n, count(*) FILTER (r > 0) / count(r) AS win_prob,
        coalesce(avg(r) FILTER (r > 0) / nullif(abs(avg(r) FILTER (r < 0)), 0), 0) AS payoff FROM r GROUP BY symbol HAVING count(*) FILTER (r < 0) > 0)
  SELECT symbol, n, round(win_prob, 6) AS win_prob, round(payoff, 6) AS payoff,
    round(greatest(CASE WHEN payoff > 0 THEN win_prob - (1 - win_prob) / payoff ELSE 0 END, 0) / 2 * 100
          / (CASE WHEN (SELECT c FROM fear) > 25 THEN 2 ELSE 1 END), 6) AS allocation_pct FROM s""")
def _(spark, sf):
    fear = bars(event_ticks(spark, sf).where(F.col("symbol") == "error"), "day")
    return rounded(rk.position_sizing(closes(spark, sf), rk.macro_flag(fear)))
