"""Threshold and event rules against the latest state of every symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.rank import ROWS, range_of, splitters
from barloom.functions.score import compare
from barloom.operators import backtest as bt
from barloom.operators import indicators as ti

# --- fixed values: risk metrics (key, label, unit, decimals, default operator, default threshold) ---
RISK_METRICS = (
    ("risk_score", "Composite Risk Score", "", 1, "<", 50.0), ("altman_z", "Altman Z-Score", "", 2, "<", P.ALTMAN_GREY),
    ("hist_var", "1-Day Historical VaR", "%", 2, "<", -0.05), ("expected_shortfall", "Expected Shortfall (CVaR)", "%", 2, "<", -0.08),
    ("max_drawdown", "Max Drawdown", "%", 2, "<", -0.20),
)
# --- fixed values: trigger types ---
PRICE_TRIGGERS = ("price_above", "price_below")
CROSS_TRIGGERS = {
    "sma_cross_bullish": ("sma", "bullish"), "sma_cross_bearish": ("sma", "bearish"),
    "macd_bullish_cross": ("macd", "bullish"), "macd_bearish_cross": ("macd", "bearish"),
}
ZONE_TRIGGERS = {"rsi_overbought": "overbought", "rsi_oversold": "oversold"}
TRIGGER_LABELS = {
    "price_above": "Price rises to or above", "price_below": "Price falls to or below",
    "sma_cross_bullish": "Price crosses above its SMA", "sma_cross_bearish": "Price crosses below its SMA",
    "macd_bullish_cross": "MACD crosses above its signal", "macd_bearish_cross": "MACD crosses below its signal",
    "rsi_overbought": "RSI enters overbought", "rsi_oversold": "RSI enters oversold",
}


def default_threshold(metric: Column, altman: Column | float = P.ALTMAN_GREY) -> Column:
    """Shipped threshold of a metric; the distress zone comes from the user's own overlay."""
    out = F.lit(None).cast("double")
    for key, *_rest, value in RISK_METRICS:
        v = altman if key == "altman_z" else F.lit(value)
        out = F.when(metric == key, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def evaluate(snapshots: DataFrame, rules: DataFrame, rows: int = ROWS) -> DataFrame:
    """Every (symbol, rule) whose metric satisfies the rule; a missing metric is no trigger.

    snapshots(symbol, metric, value) and rules(metric, op, threshold, ...).  Rules that carry a symbol look it up.  Others go through an
    interval index: the values of a metric are cut into ranges of about equal size, and a rule is sent to the ranges that its
    threshold leaves open.  All values of those but the range of the threshold itself satisfy it, so hardly a pair is compared in vain, and a metric
    is as many join keys as it has ranges.
    """
    if "symbol" in rules.columns:
        return snapshots.join(rules, ["metric", "symbol"]).where(compare(F.col("value"), F.col("op"), F.col("threshold")))
    known = snapshots.where(F.col("value").isNotNull())
    cuts = splitters(known.select("metric", "value").distinct(), ["metric"], "value", rows)
    at = lambda x: F.when(F.col("cuts").isNull(), 0).otherwise(range_of(x, F.col("cuts")))
    values = known.join(cuts, "metric", "left").withColumn("_range", at(F.col("value"))).drop("cuts")
    own, last = at(F.col("threshold")), F.coalesce(F.size("cuts"), F.lit(0))
    # values equal to a cut are in the range below it, so a threshold and what equals it share their range
    open_ = F.when(F.col("op").isin("<", "<="), F.sequence(F.lit(0), own)).when(F.col("op").isin(">", ">="), F.sequence(own, last))
    sent = rules.where(F.col("threshold").isNotNull()).join(cuts, "metric", "left").withColumn("_range", F.explode(open_)).drop("cuts")
    return values.join(sent, ["metric", "_range"]).where(compare(F.col("value"), F.col("op"), F.col("threshold"))).drop("_range")


def evaluate_watched(snapshots: DataFrame, rules: DataFrame, watch: DataFrame) -> DataFrame:
    """The triggers of every owner's rules among the symbols on the owner's own watch list(owner, symbol)."""
    mine = rules.join(watch.select("owner", "symbol").distinct(), "owner")
    return evaluate(snapshots, mine)


def indicator_state(bars: DataFrame) -> DataFrame:
    """Per symbol: last bar, RSI, and the newest SMA and MACD crossing with its date (one shared frame)."""
    frame = ti.macd(ti.rsi(ti.sma(bars.select("symbol", "ts", "close"), [P.SMA_DEFAULT])))
    frame = frame.withColumns({"_sma": bt.event_kind("sma_cross"), "_macd": bt.event_kind("macd_cross")})
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("ts"))
    return frame.groupBy("symbol").agg(
        F.max("ts").alias("last_ts"), F.max_by("close", "ts").alias("price"), F.max_by("rsi", "ts").alias("rsi"),
        F.max_by("_sma", at("_sma")).alias("sma_kind"), F.max(at("_sma")).alias("sma_ts"),
        F.max_by("_macd", at("_macd")).alias("macd_kind"), F.max(at("_macd")).alias("macd_ts"))


def evaluate_all(rules: DataFrame, state: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(rule_id, symbol, trigger_type, is_met, status, detail) for rules of all families.

    Price, indicator and risk inputs are one row per symbol, so every rule is answered by one lookup join.
    """
    known = rules.join(state.join(snapshots, "symbol", "full"), "symbol", "left")
    trig = F.col("trigger_type")
    met, status, detail = F.lit(False), F.lit("fetch_error"), F.lit("unknown trigger type")
    value = F.lit(None).cast("double")
    for key, *_r in RISK_METRICS:
        value = F.when(F.col("metric") == key, F.col(key)).otherwise(value)
    for key, label, unit, decimals, *_r in RISK_METRICS:
        is_it = (trig == "fundamental") & (F.col("metric") == key)
        shown = value * 100 if unit == "%" else value
        met = F.when(is_it, compare(value, F.col("op"), F.col("threshold"))).otherwise(met)
        status = F.when(is_it, F.when(value.isNull(), "insufficient_data").otherwise("ok")).otherwise(status)
        text = F.format_string(f"current {label}: %.{decimals}f{'%%' if unit else ''}", shown)
        detail = F.when(is_it, F.when(value.isNull(), f"{label} not computable").otherwise(text)).otherwise(detail)
    for name, (family, kind) in CROSS_TRIGGERS.items():
        k, t = F.col(f"{family}_kind"), F.col(f"{family}_ts")
        met = F.when(trig == name, (k == kind) & (t == F.col("last_ts"))).otherwise(met)
        status = F.when(trig == name, F.when(F.col("last_ts").isNull(), "insufficient_data").otherwise("ok")).otherwise(status)
        text = F.concat(F.lit("last crossing "), F.date_format(t, "yyyy-MM-dd"), F.lit(", "), k)
        none = F.when(F.col("last_ts").isNull(), "no data").otherwise("has not crossed yet")
        detail = F.when(trig == name, F.coalesce(text, none)).otherwise(detail)
    zone = ti.rsi_zone(F.col("rsi"))
    for name, wanted in ZONE_TRIGGERS.items():
        met = F.when(trig == name, zone == wanted).otherwise(met)
        status = F.when(trig == name, F.when(zone.isNull(), "insufficient_data").otherwise("ok")).otherwise(status)
        text = F.concat(F.format_string("RSI currently %.1f (", F.col("rsi")), zone, F.lit(")"))
        detail = F.when(trig == name, F.coalesce(text, F.lit("RSI not yet computable"))).otherwise(detail)
    price = F.col("price")
    for name, test in (("price_above", price >= F.col("threshold")), ("price_below", price <= F.col("threshold"))):
        met = F.when(trig == name, test).otherwise(met)
        status = F.when(trig == name, F.when(price.isNull(), "fetch_error").otherwise("ok")).otherwise(status)
        text = F.when(price.isNotNull(), F.format_string("current price $%,.2f", price)).otherwise("quote unavailable")
        detail = F.when(trig == name, text).otherwise(detail)
    return known.select("rule_id", "symbol", "trigger_type", F.coalesce(met, F.lit(False)).alias("is_met"), status.alias("status"), detail.alias("detail"))


def rule_label(rules: DataFrame) -> DataFrame:
    """The rule in words."""
    t = F.col("trigger_type")
    text = F.lit(None).cast("string")
    for name, words in TRIGGER_LABELS.items():
        shown = F.format_string(f"{words} $%,.2f", F.col("threshold")) if name in PRICE_TRIGGERS else F.lit(words)
        text = F.when(t == name, shown).otherwise(text)
    for key, label, unit, decimals, *_r in RISK_METRICS:
        value = F.col("threshold") * 100 if unit == "%" else F.col("threshold")
        number = F.format_string(f"%.{decimals}f{'%%' if unit else ''}", value)
        text = F.when((t == "fundamental") & (F.col("metric") == key), F.concat_ws(" ", F.lit(label), "op", number)).otherwise(text)
    return rules.withColumn("label", F.concat(F.col("symbol"), F.lit(": "), text))


def new_triggers(results: DataFrame, previous: DataFrame) -> DataFrame:
    """Met now and not met before; a rule without stored state counts as not met.

    previous(rule_id, was_active)."""
    both = results.join(previous.select("rule_id", "was_active"), "rule_id", "left")
    return both.where(F.col("is_met") & ~F.coalesce("was_active", F.lit(False))).drop("was_active")


def append_history(fired: DataFrame, path: str, run: str) -> None:
    """Append the triggers of one run to the history; a repeated run replaces its own part."""
    fired.write.mode("overwrite").parquet(f"{path}/run={run}")


def history(spark: SparkSession, path: str, keep: int | None = None, by: str = "symbol") -> DataFrame:
    """All triggers ever appended, or the newest ``keep`` of every ``by`` for a display (cut map-side before the shuffle)."""
    rows = spark.read.parquet(path)
    if keep is None:
        return rows
    w = Window.partitionBy(by).orderBy(F.col("ts").desc(), "rule_id")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
