"""Rule backtests and portfolio equity curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import rounded
from barloom.operators import backtest as bt
from barloom.operators.backtest import Condition, Rule
from barloom.plans.base_sql import BARS, CLASSIC, MEMBERS, MIXED, PREP, held, kinds
from barloom.plans.registry import query
from barloom.plans.risk import closes
from barloom.sources.market import baskets

CLASSIC_RULE = bt.mean_reversion()
MIXED_RULE = Rule(
    "mixed", (Condition("rsi", "<", 35.0), Condition("macd_cross", "bullish")), "OR",
    (Condition("bollinger_breakout", "upper"), Condition("sma_cross", "bearish")), "OR")


def prepared(spark, sf):
    return bt.prepare(closes(spark, sf))


BASE = f"WITH {BARS}, {PREP}, {kinds('prep', 'symbol')}"


@query("bt_prepare", f"""WITH {BARS}, {PREP} SELECT symbol, ts, round(close, 6) AS close, round(sma_20, 6) AS sma_20, round(macd_line, 5) AS macd_line,
  round(macd_signal, 5) AS macd_signal, round(bb_upper, 6) AS bb_upper, round(bb_lower, 6) AS bb_lower, round(zscore, 6) AS zscore, round(rsi, 5) AS rsi, round(r, 6) AS r FROM prep""")
def _(spark, sf):
    return rounded(prepared(spark, sf), 6, macd_line=5, macd_signal=5, rsi=5)


@query("bt_conditions", f"""{BASE} SELECT symbol, ts, coalesce({MIXED[0]}, false) AS entry, coalesce({MIXED[1]}, false) AS exit FROM kinds
  WHERE coalesce({MIXED[0]}, false) OR coalesce({MIXED[1]}, false)""")
def _(spark, sf):
    out = bt.signals(prepared(spark, sf), MIXED_RULE).where(F.col("entry") | F.col("exit"))
    return out.select("symbol", "ts", "entry", "exit")


def curves_sql(key="symbol"):
    w = f"OVER (PARTITION BY {key} ORDER BY ts)"
    return f"""curves AS MATERIALIZED (SELECT *, CASE WHEN strategy_r IS NOT NULL THEN product(1 + strategy_r) {w} END AS equity,
    CASE WHEN net_r IS NOT NULL THEN product(1 + net_r) {w} END AS net_equity, CASE WHEN r IS NOT NULL THEN product(1 + r) {w} END AS hold_equity FROM held)"""


@query("bt_equity_curve", f"""{BASE}, {held('kinds', 'symbol', *CLASSIC, 10)}, {curves_sql()}
  SELECT symbol, ts, position, round(strategy_r, 6) AS strategy_r, round(net_r, 6) AS net_r, round(equity, 4) AS equity, round(net_equity, 4) AS net_equity, round(hold_equity, 6) AS hold_equity FROM curves""")
def _(spark, sf):
    out = bt.run(prepared(spark, sf), CLASSIC_RULE, P.COST_BPS)
    return rounded(out.select("symbol", "ts", F.col("position").cast("int").alias("position"), "strategy_r", "net_r", "equity", "net_equity", "hold_equity"),
                   6, equity=4, net_equity=4)


SUMMARY = f"""{curves_sql()}, dd AS (SELECT *, (equity - max(equity) OVER w) / max(equity) OVER w AS d1,
    (net_equity - max(net_equity) OVER w) / max(net_equity) OVER w AS d2 FROM curves WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  summary AS MATERIALIZED (SELECT symbol, count(*) AS bars, (arg_max(equity, ts) FILTER (equity IS NOT NULL) - 1) * 100 AS strategy_pct,
    (arg_max(net_equity, ts) FILTER (net_equity IS NOT NULL) - 1) * 100 AS net_pct, (arg_max(hold_equity, ts) FILTER (hold_equity IS NOT NULL) - 1) * 100 AS buy_hold_pct,
    coalesce(min(d1), 0) * 100 AS max_drawdown_pct, coalesce(min(d2), 0) * 100 AS net_max_drawdown_pct,
    avg(CASE WHEN r > 0 THEN 1 ELSE 0 END) FILTER (before = 1 AND r IS NOT NULL) * 100 AS win_rate_pct,
    count(*) FILTER (moved = 1) AS trades, coalesce(sum(cost), 0) * 100 AS total_cost_pct, count(*) FILTER (entry AND exit) AS conflicts FROM dd GROUP BY symbol)"""
SUMMARY_OUT = """SELECT symbol, bars, round(strategy_pct, 3) AS strategy_pct, round(net_pct, 3) AS net_pct, round(buy_hold_pct, 5) AS buy_hold_pct,
  round(max_drawdown_pct, 5) AS max_drawdown_pct, round(net_max_drawdown_pct, 5) AS net_max_drawdown_pct, round(win_rate_pct, 5) AS win_rate_pct, trades,
  round(total_cost_pct, 5) AS total_cost_pct, conflicts FROM summary"""


@query("bt_run_classic", f"{BASE}, {held('kinds', 'symbol', *CLASSIC, 10)}, {SUMMARY} {SUMMARY_OUT}")
def _(spark, sf):
    return rounded(bt.summarize(bt.run(prepared(spark, sf), CLASSIC_RULE, P.COST_BPS)), 5, strategy_pct=3, net_pct=3)


@query("bt_run_mixed", f"{BASE}, {held('kinds', 'symbol', *MIXED, 10)}, {SUMMARY} {SUMMARY_OUT}")
def _(spark, sf):
    return rounded(bt.summarize(bt.run(prepared(spark, sf), MIXED_RULE, P.COST_BPS)), 5, strategy_pct=3, net_pct=3)


WALK = f"""WITH {BARS}, {PREP}, fed AS (SELECT prep.*, k AS win, symbol || '/' || k AS sk FROM prep, range(1000) t(k)
    WHERE n >= 168 AND k < (n - 126) // 42 AND i >= k * 42 AND i < k * 42 + 168), {kinds('fed', 'sk')}, {held('kinds', 'sk', *MIXED, 0)},
  oos AS MATERIALIZED (SELECT *, coalesce(strategy_r, 0) AS oos_r FROM held WHERE i >= 126 + win * 42)"""


@query("bt_walk_windows", f"""{WALK} SELECT symbol, win::BIGINT AS "window", min(ts) AS test_start, max(ts) AS test_end, round((product(1 + oos_r) - 1) * 100, 5) AS return_pct,
  count(*) FILTER (moved = 1) AS trades FROM oos GROUP BY symbol, win""")
def _(spark, sf):
    return rounded(bt.walk_windows(bt.walk_forward(prepared(spark, sf), MIXED_RULE)), 5)


@query("bt_walk_forward", f"""{WALK}, c AS (SELECT *, product(1 + oos_r) OVER (PARTITION BY symbol ORDER BY ts) AS equity FROM oos),
  d AS (SELECT *, (equity - max(equity) OVER w) / max(equity) OVER w AS dd FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  s AS (SELECT symbol, count(DISTINCT win) AS windows, (arg_max(equity, ts) - 1) * 100 AS total_pct, min(dd) * 100 AS max_drawdown_pct,
    avg(CASE WHEN r > 0 THEN 1 ELSE 0 END) FILTER (before = 1) * 100 AS win_rate_pct, count(*) FILTER (moved = 1) AS trades FROM d GROUP BY symbol)
  SELECT symbol, bars, bars >= 168 AS ok, CASE WHEN bars < 168 THEN bars || ' bars; at least 168 needed' END AS reason, windows, round(total_pct, 4) AS total_pct,
    round(max_drawdown_pct, 5) AS max_drawdown_pct, round(win_rate_pct, 5) AS win_rate_pct, trades
  FROM (SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol) LEFT JOIN s USING (symbol)""")
def _(spark, sf):
    daily = closes(spark, sf)
    return rounded(bt.walk_summary(bt.walk_forward(bt.prepare(daily), MIXED_RULE), daily), 5, total_pct=4)


@query("bt_weights", f"""WITH {MEMBERS[2:]}, x AS (SELECT basket, symbol, CASE WHEN basket = 'basket4' THEN weight - 1.5 ELSE weight END AS weight FROM mem)
  SELECT basket, symbol, weight, CASE WHEN min(weight) OVER w < 0 THEN 'negative weights are not supported' WHEN sum(weight) OVER w <= 0 THEN 'weights must sum to a positive number' ELSE 'ok' END AS status,
    round(CASE WHEN min(weight) OVER w >= 0 AND sum(weight) OVER w > 0 THEN weight / sum(weight) OVER w END, 6) AS target FROM x WINDOW w AS (PARTITION BY basket)""")
def _(spark, sf):
    raw = baskets(spark, sf).withColumn(
        "weight", F.when(F.col("basket") == "basket4", F.col("weight") - 1.5).otherwise(F.col("weight")))
    return rounded(bt.normalized_weights(raw))


def basket_sql(freq):
    change = {"none": "false", "monthly": "date_trunc('month', ts) <> date_trunc('month', lag(ts) OVER m)",
              "quarterly": "date_trunc('quarter', ts) <> date_trunc('quarter', lag(ts) OVER m)",
              "annually": "date_trunc('year', ts) <> date_trunc('year', lag(ts) OVER m)"}[freq]
    return f"""{BASE}, {held('kinds', 'symbol', *CLASSIC, 10)}{MEMBERS},
  live AS (SELECT basket, symbol, ts, net_r, weight FROM held JOIN mem USING (symbol) WHERE net_r IS NOT NULL),
  sp AS (SELECT basket, sum(weight) AS sw, count(*) AS size FROM (SELECT DISTINCT basket, symbol, weight FROM live) GROUP BY basket),
  al AS MATERIALIZED (SELECT basket, symbol, ts, net_r, weight / sw AS target FROM live JOIN sp USING (basket) QUALIFY count(*) OVER (PARTITION BY basket, ts) = size),
  ep AS (SELECT *, coalesce({change}, false) AS rebalanced FROM al WINDOW m AS (PARTITION BY basket, symbol ORDER BY ts)),
  e2 AS (SELECT *, sum(rebalanced::INT) OVER (PARTITION BY basket, symbol ORDER BY ts) AS epoch FROM ep),
  rw AS (SELECT *, target * coalesce(product(1 + net_r) OVER (PARTITION BY basket, symbol, epoch ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS raw FROM e2),
  wt AS MATERIALIZED (SELECT *, raw / sum(raw) OVER (PARTITION BY basket, ts) AS w FROM rw),
  dl AS (SELECT basket, ts, sum(w * net_r) AS r, sum(target * net_r) AS sr, bool_or(rebalanced) AS rebalanced FROM wt GROUP BY basket, ts),
  cv AS MATERIALIZED (SELECT *, product(1 + r) OVER w AS equity, product(1 + sr) OVER w AS static_equity FROM dl WINDOW w AS (PARTITION BY basket ORDER BY ts))"""


def basket_returns(spark, sf):
    runs = bt.run(prepared(spark, sf), CLASSIC_RULE, P.COST_BPS)
    return bt.basket_returns(runs, bt.normalized_weights(baskets(spark, sf)))


@query("bt_portfolio_weights", f"""{basket_sql('monthly')} SELECT basket, symbol, ts, round(target, 6) AS target, round(w, 6) AS weight, rebalanced,
  round(w * net_r, 8) AS contribution FROM wt""")
def _(spark, sf):
    out = bt.drifting_weights(basket_returns(spark, sf), "monthly")
    return rounded(out.select("basket", "symbol", "ts", "target", "weight", "rebalanced", "contribution"), 6, contribution=8)


@query("bt_portfolio_curve", f"""{basket_sql('quarterly')} SELECT basket, ts, round(r, 6) AS r, round(sr, 6) AS static_r, rebalanced, round(equity, 5) AS equity, round(static_equity, 5) AS static_equity FROM cv""")
def _(spark, sf):
    return rounded(bt.portfolio_curve(bt.drifting_weights(basket_returns(spark, sf), "quarterly")), 6, equity=5, static_equity=5)


@query("bt_portfolio_summary", f"""{basket_sql('none')}, d AS (SELECT *, (equity - max(equity) OVER w) / max(equity) OVER w AS dd, ln(equity / lag(equity) OVER w) AS lr FROM cv WINDOW w AS (PARTITION BY basket ORDER BY ts))
  SELECT basket, count(*) AS days, count(*) FILTER (rebalanced) AS rebalances, round((arg_max(equity, ts) - 1) * 100, 4) AS total_pct, round((arg_max(static_equity, ts) - 1) * 100, 4) AS static_pct,
    round(min(dd) * 100, 5) AS max_drawdown_pct, round((avg(lr) * 252 - 0.04) / nullif(stddev_samp(lr) * sqrt(252), 0), 5) AS sharpe FROM d GROUP BY basket""")
def _(spark, sf):
    curve = bt.portfolio_curve(bt.drifting_weights(basket_returns(spark, sf), "none"))
    return rounded(bt.portfolio_summary(curve), 5, total_pct=4, static_pct=4)


@query("bt_contributions", f"""{basket_sql('annually')}, {SUMMARY} SELECT basket, symbol, round(any_value(target), 6) AS target, round(sum(w * wt.net_r) * 100, 5) AS contribution_pct,
  round(any_value(net_pct), 3) AS net_pct, any_value(trades) AS trades FROM wt JOIN summary USING (symbol) GROUP BY basket, symbol""")
def _(spark, sf):
    runs = bt.run(prepared(spark, sf), CLASSIC_RULE, P.COST_BPS)
    weighted = bt.drifting_weights(bt.basket_returns(runs, bt.normalized_weights(baskets(spark, sf))), "annually")
    return rounded(bt.contributions(weighted, bt.summarize(runs)), 5, net_pct=3, target=6)


def _threshold_sql(period="NULL"):
    """The walk as a recursion over the days of each basket."""
    return f"""{basket_sql('none')}, dy AS MATERIALIZED (SELECT basket, ts, row_number() OVER (PARTITION BY basket ORDER BY ts) AS i, {period} AS p, rl, tl FROM (
      SELECT basket, ts, list(net_r ORDER BY symbol) AS rl, list(target ORDER BY symbol) AS tl FROM al GROUP BY ALL)),
    walk AS (WITH RECURSIVE w(basket, i, held, reset) AS (SELECT basket, i, tl, false FROM dy WHERE i = 1 UNION ALL
      SELECT basket, i, CASE WHEN off THEN tl ELSE now END, off FROM (SELECT *, list_max(list_transform(list_zip(now, tl), lambda z: abs(z[1] - z[2]))) * 100 > 5 OR coalesce(turn, false) AS off FROM (
        SELECT n.basket, n.i, n.tl, n.p <> p.p AS turn, CASE WHEN list_sum(g) > 0 THEN list_transform(g, lambda x: x / list_sum(g)) ELSE n.tl END AS now FROM (
          SELECT w.basket, w.i, d.p, list_transform(list_zip(w.held, d.rl), lambda z: z[1] * (1 + z[2])) AS g FROM w JOIN dy d ON d.basket = w.basket AND d.i = w.i) p
          JOIN dy n ON n.basket = p.basket AND n.i = p.i + 1))) SELECT * FROM w),
    dr AS (SELECT d.basket, d.ts, reset, list_sum(list_transform(list_zip(held, rl), lambda z: z[1] * z[2])) AS r, list_sum(list_transform(list_zip(tl, rl), lambda z: z[1] * z[2])) AS sr FROM walk JOIN dy d ON d.basket = walk.basket AND d.i = walk.i),
    ec AS (SELECT *, product(1 + r) OVER w AS equity, product(1 + sr) OVER w AS static_equity FROM dr WINDOW w AS (PARTITION BY basket ORDER BY ts)),
    d AS (SELECT *, (equity - max(equity) OVER w) / max(equity) OVER w AS dd, ln(equity / lag(equity) OVER w) AS lr FROM ec WINDOW w AS (PARTITION BY basket ORDER BY ts))
    SELECT basket, count(*) AS days, count(*) FILTER (reset) AS rebalances, round((arg_max(equity, ts) - 1) * 100, 4) AS total_pct, round((arg_max(static_equity, ts) - 1) * 100, 4) AS static_pct,
      round(min(dd) * 100, 5) AS max_drawdown_pct, round((avg(lr) * 252 - 0.04) / nullif(stddev_samp(lr) * sqrt(252), 0), 5) AS sharpe FROM d GROUP BY basket"""


@query("bt_portfolio_threshold", _threshold_sql())
def _(spark, sf):
    out = bt.drifting_weights(basket_returns(spark, sf), threshold_pct=5.0)
    return rounded(bt.portfolio_summary(bt.portfolio_curve(out)), 5, total_pct=4, static_pct=4)


@query("bt_portfolio_period_threshold", _threshold_sql("date_trunc('quarter', ts)"))
def _(spark, sf):
    out = bt.drifting_weights(basket_returns(spark, sf), "quarterly", 5.0)
    return rounded(bt.portfolio_summary(bt.portfolio_curve(out)), 5, total_pct=4, static_pct=4)
