"""Rules as data, positions as windows, equity curves as running products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import KEY, over_time, prev, running, sdiv, whole
from barloom.operators import indicators as ti
from barloom.operators.risk import YEAR, simple_returns
from barloom.session import stage


@dataclass(frozen=True)
class Condition:
    indicator: str  # rsi, zscore (levels); sma_cross, macd_cross, bollinger_breakout (events)
    op: str  # <, >, <=, >= for levels; the event kind otherwise
    threshold: float | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    entry: tuple[Condition, ...]
    entry_logic: str
    exit: tuple[Condition, ...]
    exit_logic: str


def mean_reversion(buy: float = -2.0, sell: float = 0.0) -> Rule:
    return Rule("mean reversion", (Condition("zscore", "<", buy),), "AND", (Condition("zscore", ">", sell),), "AND")


LEVELS = {"rsi": "rsi", "zscore": "zscore"}
EVENTS = {"sma_cross": ("close", f"sma_{P.SMA_DEFAULT}"), "macd_cross": ("macd_line", "macd_signal")}


def prepare(bars: DataFrame, n_sma: int = P.SMA_DEFAULT, n_rsi: int = P.RSI_PERIOD) -> DataFrame:
    """Bars with every column a rule can read; symbols with too few bars are left out."""
    enough = F.count(F.lit(1)).over(whole()) >= max(n_sma, n_rsi) + 2
    base = bars.select("symbol", "ts", "close").withColumn("_ok", enough).where("_ok").drop("_ok")
    return simple_returns(ti.macd(ti.rsi(ti.zscore(ti.bollinger(ti.sma(base, [n_sma])))))).drop("macd_hist", "bb_middle")


def _entered(state: Column, key: Sequence[str]) -> Column:
    before = F.last(state, ignorenulls=True).over(over_time(key=key).rowsBetween(Window.unboundedPreceding, -1))
    return F.when(state.isNotNull() & before.isNotNull() & (state != before), state)


def event_kind(indicator: str, key: Sequence[str] = KEY) -> Column:
    """The kind of event firing on this very bar, NULL on all others."""
    if indicator == "bollinger_breakout":
        state = F.when(F.col("close") > F.col("bb_upper"), "upper").when(F.col("close") < F.col("bb_lower"), "lower").when(
            F.col("bb_upper").isNotNull(), "inside")
        return _entered(state, key)
    a, b = EVENTS[indicator]
    state = F.when(F.col(a) > F.col(b), "bullish").when(F.col(a) <= F.col(b), "bearish")
    return _entered(state, key)


def holds(c: Condition, key: Sequence[str] = KEY) -> Column:
    if c.indicator in LEVELS:
        x, t = F.col(LEVELS[c.indicator]), F.lit(c.threshold)
        test = {"<": x < t, ">": x > t, "<=": x <= t, ">=": x >= t}[c.op]
    elif c.indicator in EVENTS or c.indicator == "bollinger_breakout":
        test = event_kind(c.indicator, key) == c.op
    else:
        raise ValueError(f"unknown condition indicator {c.indicator!r}")
    return F.coalesce(test, F.lit(False))


def all_hold(conds: Sequence[Condition], logic: str, key: Sequence[str] = KEY) -> Column:
    if not conds:
        return F.lit(False)
    return reduce(lambda x, y: (x & y) if logic == "AND" else (x | y), [holds(c, key) for c in conds])


def signals(df: DataFrame, rule: Rule, key: Sequence[str] = KEY) -> DataFrame:
    return df.withColumns({
        "entry": all_hold(rule.entry, rule.entry_logic, key), "exit": all_hold(rule.exit, rule.exit_logic, key)})


def positions(df: DataFrame, key: Sequence[str] = KEY, cost_bps: float = 0.0) -> DataFrame:
    """Held position, strategy return and net return of every bar; exits win ties."""
    mark = F.when(F.col("exit"), 0.0).when(F.col("entry"), 1.0)
    step = df.withColumn("position", F.coalesce(F.last(mark, ignorenulls=True).over(running(key)), F.lit(0.0)))
    step = step.withColumn("held", prev(F.col("position"), key=key))
    moved = F.col("position") - F.col("held")
    step = step.withColumns({"moved": moved, "strategy_r": F.col("held") * F.col("r"), "cost": F.abs(moved) * (cost_bps / 1e4)})
    return step.withColumn("net_r", F.col("strategy_r") - F.col("cost"))


def curves(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Gross, net and buy-and-hold growth; the first bar stays NULL."""
    grow = lambda c: F.when(F.col(c).isNotNull(), F.product(1 + F.col(c)).over(running(key)))
    return df.withColumns({"equity": grow("strategy_r"), "net_equity": grow("net_r"), "hold_equity": grow("r")})


def _mdd(df: DataFrame, col: str, key: Sequence[str]) -> DataFrame:
    """Running drawdown of an equity column without disturbing the rest of the row."""
    peak = F.max(col).over(running(key))
    return df.withColumn(f"{col}_dd", sdiv(F.col(col) - peak, peak))


def summarize(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    step = _mdd(_mdd(df, "equity", key), "net_equity", key)
    active = (F.col("held") == 1) & F.col("r").isNotNull()
    at_end = lambda c: (F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))) - 1) * 100
    return step.groupBy(*key).agg(
        F.count(F.lit(1)).alias("bars"),
        at_end("equity").alias("strategy_pct"), at_end("net_equity").alias("net_pct"),
        at_end("hold_equity").alias("buy_hold_pct"),
        (F.coalesce(F.min("equity_dd"), F.lit(0.0)) * 100).alias("max_drawdown_pct"),
        (F.coalesce(F.min("net_equity_dd"), F.lit(0.0)) * 100).alias("net_max_drawdown_pct"),
        (F.avg(F.when(active, (F.col("r") > 0).cast("double"))) * 100).alias("win_rate_pct"),
        F.count_if(F.col("moved") == 1).alias("trades"),
        (F.coalesce(F.sum("cost"), F.lit(0.0)) * 100).alias("total_cost_pct"),
        F.count_if(F.col("entry") & F.col("exit")).alias("conflicts"),
    )


def run(prepared: DataFrame, rule: Rule, cost_bps: float = 0.0) -> DataFrame:
    """Per-bar result of one rule on every symbol."""
    return curves(positions(signals(prepared, rule), cost_bps=cost_bps))


def walk_forward(prepared: DataFrame, rule: Rule, train: int = P.WALK_TRAIN, test: int = P.WALK_TEST) -> DataFrame:
    """Out-of-sample bars: each test block is warmed by its own ``train`` bars and starts flat.

    A bar feeds at most train/test + 1 windows, so exploding it is a constant blow-up;
    afterwards (symbol, window) is the key and a long history runs in parallel.
    """
    w = over_time()
    base = prepared.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole())})
    windows = F.floor((F.col("_n") - train) / test)
    first = F.greatest(F.floor((F.col("_i") - train) / test), F.lit(0))
    final = F.least(F.floor(F.col("_i") / test), windows - 1)
    fed = base.where((F.col("_n") >= train + test) & (first <= final)).withColumn("window", F.explode(F.sequence(first, final)))
    key = ("symbol", "window")
    marked = positions(signals(fed, rule, key), key)
    return marked.where(F.col("_i") >= train + F.col("window") * test).select(
        "symbol", "window", "ts", F.coalesce("strategy_r", F.lit(0.0)).alias("oos_r"), "r", "held", "moved")


def walk_windows(oos: DataFrame) -> DataFrame:
    return oos.groupBy("symbol", "window").agg(
        F.min("ts").alias("test_start"), F.max("ts").alias("test_end"),
        ((F.product(1 + F.col("oos_r")) - 1) * 100).alias("return_pct"),
        F.count_if(F.col("moved") == 1).alias("trades"))


def walk_summary(oos: DataFrame, bars: DataFrame, train: int = P.WALK_TRAIN, test: int = P.WALK_TEST) -> DataFrame:
    """One row per symbol, also for those with too little history (ok = false and a reason)."""
    curve = oos.withColumn("equity", F.product(1 + F.col("oos_r")).over(running()))
    curve = _mdd(curve, "equity", KEY)
    active = F.col("held") == 1
    stats = curve.groupBy("symbol").agg(
        F.count_distinct("window").alias("windows"), ((F.max_by("equity", "ts") - 1) * 100).alias("total_pct"),
        (F.min("equity_dd") * 100).alias("max_drawdown_pct"),
        (F.avg(F.when(active, (F.col("r") > 0).cast("double"))) * 100).alias("win_rate_pct"),
        F.count_if(F.col("moved") == 1).alias("trades"))
    have = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    out = have.join(stats, "symbol", "left")
    ok = F.col("bars") >= train + test
    return out.withColumns({
        "ok": ok, "reason": F.when(~ok, F.format_string(f"%d bars; at least {train + test} needed", F.col("bars")))})


def normalized_weights(weights: DataFrame) -> DataFrame:
    """(basket, symbol, weight, target, status): weights rescaled to 1, or the reason why not."""
    w = Window.partitionBy("basket")
    total, low = F.sum("weight").over(w), F.min("weight").over(w)
    status = F.when(low < 0, "negative weights are not supported").when(total <= 0, "weights must sum to a positive number").otherwise("ok")
    return weights.withColumn("status", status).withColumn(
        "target", F.when(F.col("status") == "ok", F.col("weight") / F.sum("weight").over(w)))


PERIODS = {"monthly": "MONTH", "quarterly": "QUARTER", "annually": "YEAR"}


def basket_returns(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Net strategy returns of the basket members on common dates, weights re-spread over the survivors."""
    rets = runs.where(F.col("net_r").isNotNull()).select("symbol", "ts", "net_r")
    # one pass over the indicator stack: who survives, how many, and the days all share are read from what it left
    live = stage(rets.join(targets.where(F.col("target") > 0).select("basket", "symbol", "target"), "symbol"))
    survivors = live.select("basket", "symbol", "target").distinct()
    spread = survivors.groupBy("basket").agg(F.sum("target").alias("_sum"), F.count(F.lit(1)).alias("_size"))
    common = live.groupBy("basket", "ts").agg(F.count(F.lit(1)).alias("_here")).join(spread, "basket").where(F.col("_here") == F.col("_size"))
    return live.join(common, ["basket", "ts"]).select("basket", "symbol", "ts", "net_r", (F.col("target") / F.col("_sum")).alias("target"))


def drifting_weights(returns: DataFrame, freq: str = "none", threshold_pct: float | None = None) -> DataFrame:
    """Weights drift with returns; they go back to the targets on the first bar of a new period, when one is off its target by more than the
    threshold, and after a bar that left nothing to divide (a total of zero or less).

    Without a threshold the drifted weight inside one period is target * product(1 + r) of the earlier bars, rescaled per date: one running
    product per (basket, symbol, period).  A threshold, or a lost total, makes a reset depend on the drifted state; such baskets are walked.
    """
    if threshold_pct is not None:
        return walked_weights(returns, freq, threshold_pct)
    member = ("basket", "symbol")
    if freq == "none":
        step = returns.withColumns({"epoch": F.lit(0).cast("long"), "rebalanced": F.lit(False)})
    else:
        step = returns.withColumn("_p", F.date_trunc(PERIODS[freq], F.col("ts")))
        changed = F.coalesce(F.col("_p") != prev(F.col("_p"), key=member), F.lit(False))
        step = step.withColumn("rebalanced", changed).drop("_p")
        step = step.withColumn("epoch", F.sum(F.col("rebalanced").cast("long")).over(running(member)))
    before = over_time((*member, "epoch")).rowsBetween(Window.unboundedPreceding, -1)
    raw = F.col("target") * F.coalesce(F.product(1 + F.col("net_r")).over(before), F.lit(1.0))
    step = step.withColumn("_raw", raw)
    totals = step.groupBy("basket", "ts").agg(F.sum("_raw").alias("_total"), F.sum(F.col("_raw") * (1 + F.col("net_r"))).alias("_after"))
    lost = totals.where(F.col("_after") <= 0).select("basket").distinct()
    step = step.join(totals.drop("_after"), ["basket", "ts"]).join(lost, "basket", "left_anti")
    step = step.withColumn("weight", sdiv(F.col("_raw"), F.col("_total")))
    closed = step.select(*STREAM, "net_r", "target", "weight", "rebalanced", (F.col("weight") * F.col("net_r")).alias("contribution"))
    return closed.unionByName(walked_weights(returns.join(lost, "basket", "left_semi"), freq))


STREAM = ("basket", "ts", "symbol")


class _Walk:
    """The state of one basket: its members' weights and the period of the last date."""

    def __init__(self, threshold_pct: float | None):
        self.limit, self.basket = threshold_pct, None

    def day(self, basket, symbols: list, period, r: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, bool]:
        if basket != self.basket:
            self.basket, self.period, self.now = basket, period, dict(zip(symbols, target))
        now = np.array([self.now.get(s, t) for s, t in zip(symbols, target)])
        reset = period != self.period or (self.limit is not None and float(np.abs(now - target).max()) * 100 > self.limit)
        held = target.copy() if reset else now
        drifted = held * (1 + r)
        total = drifted.sum()
        self.period, self.now = period, dict(zip(symbols, drifted / total if total > 0 else target))
        return held, reset


def _walked(threshold_pct: float | None):
    """Sorted rows in, the same rows with weights out; a date's rows are held together, nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, waiting = _Walk(threshold_pct), None
        for batch in _then_none(batches):
            rows = waiting if batch is None else pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            basket, ts = rows.column("basket").to_pylist(), rows.column("ts").cast(pa.int64()).to_numpy()
            cuts = [i for i in range(1, len(basket)) if basket[i] != basket[i - 1] or ts[i] != ts[i - 1]]
            # the last date may go on in the next batch
            end = len(basket) if batch is None else cuts[-1] if cuts else 0
            waiting = rows.slice(end)
            if not end:
                continue
            symbols, period = rows.column("symbol").to_pylist(), rows.column("_p").cast(pa.int64()).to_pylist()
            r, target = rows.column("net_r").to_numpy(), rows.column("target").to_numpy()
            weights, resets = np.empty(end), np.zeros(end, bool)
            edges = [0, *[c for c in cuts if c < end], end]
            for a, b in zip(edges, edges[1:]):
                weights[a:b], resets[a:b] = walk.day(basket[a], symbols[a:b], period[a], r[a:b], target[a:b])
            done = rows.slice(0, end).select([*STREAM, "net_r", "target"])
            for name, column in (("weight", pa.array(weights)), ("rebalanced", pa.array(resets)), ("contribution", pa.array(weights * r[:end]))):
                done = done.append_column(name, column)
            yield from done.combine_chunks().to_batches()

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def walked_weights(returns: DataFrame, freq: str = "none", threshold_pct: float | None = None) -> DataFrame:
    """The walk over the dates of every basket: one sorted stream, of which a task holds one date's members at a time."""
    period = F.lit(None).cast("timestamp_ntz") if freq == "none" else F.date_trunc(PERIODS[freq], F.col("ts")).cast("timestamp_ntz")
    rows = returns.select(*STREAM, "net_r", "target", period.alias("_p")).repartition("basket").sortWithinPartitions(*STREAM)
    return rows.mapInArrow(_walked(threshold_pct), (
        "basket string, ts timestamp_ntz, symbol string, net_r double, target double, weight double, rebalanced boolean, contribution double"))


def portfolio_curve(weighted: DataFrame) -> DataFrame:
    daily = weighted.groupBy("basket", "ts").agg(
        F.sum("contribution").alias("r"), F.sum(F.col("target") * F.col("net_r")).alias("static_r"),
        F.bool_or("rebalanced").alias("rebalanced"))
    grow = lambda c: F.product(1 + F.col(c)).over(running(("basket",)))
    return daily.withColumns({"equity": grow("r"), "static_equity": grow("static_r")})


def portfolio_summary(curve: DataFrame, rf: float = P.RISK_FREE) -> DataFrame:
    key = ("basket",)
    step = _mdd(curve, "equity", key).withColumn("lr", F.log(sdiv(F.col("equity"), prev(F.col("equity"), key=key))))
    return step.groupBy("basket").agg(
        F.count(F.lit(1)).alias("days"), F.count_if("rebalanced").alias("rebalances"),
        ((F.max_by("equity", "ts") - 1) * 100).alias("total_pct"),
        ((F.max_by("static_equity", "ts") - 1) * 100).alias("static_pct"),
        (F.min("equity_dd") * 100).alias("max_drawdown_pct"),
        F.when(F.count("lr") >= 2, sdiv(F.avg("lr") * YEAR - rf, F.stddev_samp("lr") * YEAR**0.5)).alias("sharpe"))


def contributions(weighted: DataFrame, solo: DataFrame) -> DataFrame:
    """Target weight, contribution, and each member's stand-alone result."""
    part = weighted.groupBy("basket", "symbol").agg(
        F.first("target").alias("target"), (F.sum("contribution") * 100).alias("contribution_pct"))
    return part.join(solo.select("symbol", "net_pct", "trades"), "symbol")
