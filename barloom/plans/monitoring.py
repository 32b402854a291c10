"""Alert, digest, verdict and view queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import rounded
from barloom.operators import alerts as al
from barloom.operators import digest as dg
from barloom.operators import fundamentals as fa
from barloom.operators import holdings as ph
from barloom.operators import risk as rk
from barloom.operators import screen as sc
from barloom.plans.base_sql import BANDS_CTE, BARS, BREAKS, MACD_CTE, RETS, RETURNS, SMA_CTE, flips
from barloom.plans.company_sql import ANALYZED, BRAND_ANALYZED
from barloom.plans.fundamentals import DCF, DCF_STATUS, GROWTH, QUALITY, SCORE, analyzed
from barloom.plans.holdings import END, TWR, VALUE, staged_lots
from barloom.plans.registry import query
from barloom.plans.replay import RISK_SCORE
from barloom.plans.risk import METRICS, PERF, closes, drawdown_sql, staged_closes, tail_sql
from barloom.plans.screen import WIDE_SQL, full_metrics, risk_inputs
from barloom.plans.technical import indicator_events
from barloom.operators.events import recent_events
from barloom.sources.bars import bars
from barloom.sources.market import benchmark, brand_number, event_ticks
from barloom.sources.tables import table

TRIGGERS = (*al.PRICE_TRIGGERS, *al.CROSS_TRIGGERS, *al.ZONE_TRIGGERS, "fundamental", "volume_spike")
METRIC_KEYS = tuple(k for k, *_ in al.RISK_METRICS)


def rules(spark, sf):
    """One rule of every trigger type per brand, plus one on an unknown symbol."""
    names = table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    n = brand_number()
    r = names.select("symbol", n.cast("long").alias("n"), F.explode(F.array(*[F.lit(t) for t in TRIGGERS])).alias("trigger_type"))
    metric = F.element_at(F.array(*[F.lit(k) for k in METRIC_KEYS]), (F.col("n") % 5 + 1).cast("int"))
    fund = F.col("trigger_type") == "fundamental"
    threshold = F.when(F.col("trigger_type").isin(*al.PRICE_TRIGGERS), 100.5 + F.col("n") % 5).when(fund, al.default_threshold(metric))
    return r.select(F.concat_ws("/", "symbol", "trigger_type").alias("rule_id"), "symbol", "trigger_type", threshold.alias("threshold"),
                    F.when(fund, metric).alias("metric"), F.when(fund, F.lit("<")).alias("op"), "n")


def snapshots(spark, sf, daily=None):
    wide = rk.risk_score(risk_inputs(spark, sf, daily))
    return wide.select("symbol", *METRIC_KEYS)


def results(spark, sf):
    daily = staged_closes(spark, sf)
    return al.evaluate_all(rules(spark, sf), al.indicator_state(daily), snapshots(spark, sf, daily))


_DEF = {k: t for k, *_r, t in al.RISK_METRICS}
RULES = f"""ru0 AS (SELECT DISTINCT p_brand AS symbol, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS n FROM part),
  ru1 AS (SELECT *, [{', '.join(repr(k) for k in METRIC_KEYS)}][n % 5 + 1] AS mk FROM ru0, (SELECT unnest([{', '.join(repr(t) for t in TRIGGERS)}]) AS trigger_type)),
  ru AS MATERIALIZED (SELECT symbol || '/' || trigger_type AS rule_id, symbol, trigger_type, n, CASE WHEN trigger_type IN ('price_above', 'price_below') THEN 100.5::DOUBLE + n % 5
    WHEN trigger_type = 'fundamental' THEN CASE mk {' '.join(f"WHEN '{k}' THEN {t}" for k, t in _DEF.items())} END END::DOUBLE AS threshold, CASE WHEN trigger_type = 'fundamental' THEN mk END AS metric FROM ru1)"""
SNAP = f"""snap AS MATERIALIZED (SELECT symbol, {RISK_SCORE} AS risk_score, altman_z, hist_var, expected_shortfall, max_drawdown, rsi FROM wide)"""
STATE = f"""{SMA_CTE}, {MACD_CTE}, {flips('es', 'sma', 'close', 'sma_20', 'sma')}, {flips('em', 'macd', 'macd_line', 'macd_signal', 'macd')},
  state AS MATERIALIZED (SELECT b.symbol, b.last_ts, b.price, s.kind AS sma_kind, s.ts AS sma_ts, m.kind AS macd_kind, m.ts AS macd_ts FROM (SELECT symbol, max(ts) AS last_ts, arg_max(close, ts) AS price FROM bars GROUP BY symbol) b
    LEFT JOIN (SELECT symbol, arg_max(kind, ts) AS kind, max(ts) AS ts FROM es GROUP BY symbol) s USING (symbol) LEFT JOIN (SELECT symbol, arg_max(kind, ts) AS kind, max(ts) AS ts FROM em GROUP BY symbol) m USING (symbol))"""
_VAL = "CASE metric " + " ".join(f"WHEN '{k}' THEN {k}" for k in METRIC_KEYS) + " END"
_FUND = "CASE metric " + " ".join(
    f"WHEN '{k}' THEN CASE WHEN v IS NULL THEN '{lab} not computable' ELSE format('current {lab}: {{:.{d}f}}{'%' if u else ''}', v{' * 100' if u else ''}) END" for k, lab, u, d, *_ in al.RISK_METRICS) + " END"
EVAL = f"""ev0 AS (SELECT ru.*, price, last_ts, sma_kind, sma_ts, macd_kind, macd_ts, rsi, {_VAL} AS v FROM ru LEFT JOIN state USING (symbol) LEFT JOIN snap USING (symbol)),
  evl AS MATERIALIZED (SELECT rule_id, symbol, trigger_type, n, coalesce(CASE trigger_type WHEN 'price_above' THEN price >= threshold WHEN 'price_below' THEN price <= threshold WHEN 'sma_cross_bullish' THEN sma_kind = 'bullish' AND sma_ts = last_ts
      WHEN 'sma_cross_bearish' THEN sma_kind = 'bearish' AND sma_ts = last_ts WHEN 'macd_bullish_cross' THEN macd_kind = 'bullish' AND macd_ts = last_ts WHEN 'macd_bearish_cross' THEN macd_kind = 'bearish' AND macd_ts = last_ts
      WHEN 'rsi_overbought' THEN rsi >= 70 WHEN 'rsi_oversold' THEN rsi <= 30 WHEN 'fundamental' THEN v < threshold ELSE false END, false) AS is_met,
    CASE WHEN trigger_type LIKE 'price%' THEN CASE WHEN price IS NULL THEN 'fetch_error' ELSE 'ok' END WHEN trigger_type LIKE '%cross%' THEN CASE WHEN last_ts IS NULL THEN 'insufficient_data' ELSE 'ok' END
      WHEN trigger_type LIKE 'rsi%' THEN CASE WHEN rsi IS NULL THEN 'insufficient_data' ELSE 'ok' END WHEN trigger_type = 'fundamental' THEN CASE WHEN v IS NULL THEN 'insufficient_data' ELSE 'ok' END ELSE 'fetch_error' END AS status,
    CASE WHEN trigger_type LIKE 'price%' THEN coalesce(format('current price ${{:,.2f}}', price), 'quote unavailable') WHEN trigger_type LIKE 'sma%' THEN coalesce('last crossing ' || strftime(sma_ts, '%Y-%m-%d') || ', ' || sma_kind, 'has not crossed yet')
      WHEN trigger_type LIKE 'macd%' THEN coalesce('last crossing ' || strftime(macd_ts, '%Y-%m-%d') || ', ' || macd_kind, 'has not crossed yet')
      WHEN trigger_type LIKE 'rsi%' THEN coalesce(format('RSI currently {{:.1f}} (', rsi) || CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' ELSE 'neutral' END || ')', 'RSI not yet computable')
      WHEN trigger_type = 'fundamental' THEN {_FUND} ELSE 'unknown trigger type' END AS detail FROM ev0)"""
ALERTS = f"{WIDE_SQL}, {SNAP}, {STATE}, {RULES}, {EVAL}"


@query("al_evaluate_all", f"WITH {ALERTS} SELECT rule_id, symbol, trigger_type, is_met, status, detail FROM evl")
def _(spark, sf):
    return results(spark, sf)


@query("al_new_triggers", f"WITH {ALERTS} SELECT rule_id, symbol, trigger_type, is_met, status, detail FROM evl WHERE is_met AND NOT (n % 3 = 0 AND n % 2 = 1)")
def _(spark, sf):
    previous = rules(spark, sf).where(F.col("n") % 3 == 0).select("rule_id", (F.col("n") % 2 == 1).alias("was_active"))
    return al.new_triggers(results(spark, sf), previous)


_RL = "CASE metric " + " ".join(f"WHEN '{k}' THEN '{lab} < ' || format('{{:.{d}f}}{'%' if u else ''}', threshold{' * 100' if u else ''})" for k, lab, u, d, *_ in al.RISK_METRICS) + " END"


@query("al_rule_labels", f"""WITH {RULES} SELECT rule_id, symbol || ': ' || CASE trigger_type {' '.join(f"WHEN '{t}' THEN " + (f"format('{w} ${{:,.2f}}', threshold)" if t in al.PRICE_TRIGGERS else f"'{w}'") for t, w in al.TRIGGER_LABELS.items())}
  WHEN 'fundamental' THEN {_RL} END AS label FROM ru""")
def _(spark, sf):
    return al.rule_label(rules(spark, sf)).select("rule_id", "label")


def owner_rules(spark, sf):
    """Two risk rules per nation, and the watch list it follows."""
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    metric = F.element_at(F.array(*[F.lit(m) for m in METRIC_KEYS]), (k % 5 + 1).cast("int"))
    own = n.select(F.col("n_name").alias("owner"), metric.alias("metric"), F.lit("<").alias("op"), al.default_threshold(metric).alias("threshold"))
    dd = n.select(F.col("n_name").alias("owner"), F.lit("max_drawdown").alias("metric"), F.lit("<").alias("op"), (-0.10 - (k % 4) * 0.02).alias("threshold"))
    return own.where(F.col("metric") != "max_drawdown").unionByName(dd)


def watch_lists(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn("g", brand_number() % 5)
    n = table(spark, sf, "nation").select(F.col("n_name").alias("owner"), (F.col("n_nationkey") % 5).alias("g"))
    return n.join(names, "g").select("owner", "symbol", brand_number().cast("long").alias("pos"))


OWNERS = f"""orl AS (SELECT * FROM (SELECT n_name AS owner, [{', '.join(repr(k) for k in METRIC_KEYS)}][n_nationkey % 5 + 1] AS metric FROM nation) WHERE metric <> 'max_drawdown'),
  rl AS MATERIALIZED (SELECT owner, metric, CASE metric {' '.join(f"WHEN '{k}' THEN {t}" for k, t in _DEF.items())} END::DOUBLE AS threshold FROM orl UNION ALL SELECT n_name, 'max_drawdown', -0.10::DOUBLE - (n_nationkey % 4) * 0.02::DOUBLE FROM nation),
  wl_ AS MATERIALIZED (SELECT DISTINCT n_name AS owner, p_brand AS symbol, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS pos FROM nation JOIN part ON n_nationkey % 5 = regexp_extract(p_brand, '([0-9]+)', 1)::INT % 5),
  sl AS ({' UNION ALL '.join(f"SELECT symbol, '{k}' AS metric, {k} AS value FROM snap" for k in METRIC_KEYS)}),
  br AS MATERIALIZED (SELECT rl.owner, sl.symbol, metric, threshold, value FROM sl JOIN rl USING (metric) JOIN wl_ ON wl_.owner = rl.owner AND wl_.symbol = sl.symbol WHERE value < threshold)"""


def owner_breaches(spark, sf, daily=None):
    long = sc.long_metrics(snapshots(spark, sf, daily), {k: k for k in METRIC_KEYS})
    return dg.breach_lines(al.evaluate_watched(long, owner_rules(spark, sf), watch_lists(spark, sf)))


@query("al_evaluate_risk", f"WITH {WIDE_SQL}, {SNAP}, {OWNERS} SELECT owner, rl.metric, sl.symbol, round(threshold, 4) AS threshold, round(value, 6) AS value FROM sl JOIN rl USING (metric) WHERE value < threshold")
def _(spark, sf):
    long = sc.long_metrics(snapshots(spark, sf), {k: k for k in METRIC_KEYS})
    out = al.evaluate(long, owner_rules(spark, sf)).drop("op")
    return rounded(out, 6, threshold=4)


@query("al_watched_risk", f"WITH {WIDE_SQL}, {SNAP}, {OWNERS} SELECT owner, metric, symbol, round(threshold, 4) AS threshold, round(value, 6) AS value FROM br")
def _(spark, sf):
    long = sc.long_metrics(snapshots(spark, sf), {k: k for k in METRIC_KEYS})
    return rounded(al.evaluate_watched(long, owner_rules(spark, sf), watch_lists(spark, sf)).drop("op"), 6, threshold=4)


@query("dg_risk_breaches", f"WITH {WIDE_SQL}, {SNAP}, {OWNERS} SELECT owner, symbol, metric, format('{{}}  {{}} < {{:.2f}}  (now {{:.4f}})', symbol, metric, threshold, value) AS line FROM br")
def _(spark, sf):
    return owner_breaches(spark, sf).select("owner", "symbol", "metric", "line")


DIG_END, DIG_DAYS = "2001-06-30", 30
MOVES = f"""mv AS MATERIALIZED (SELECT s.symbol, CASE WHEN n IS NULL THEN 'no closes' WHEN n < 2 THEN 'a single close' WHEN a = 0 THEN 'first close is zero' END AS unavailable, a, b FROM (SELECT DISTINCT p_brand AS symbol FROM part) s
  LEFT JOIN (SELECT symbol, count(*) AS n, arg_min(close, ts) AS a, arg_max(close, ts) AS b FROM bars WHERE ts::DATE >= DATE '{DIG_END}' - {DIG_DAYS} AND ts::DATE < DATE '{DIG_END}' GROUP BY symbol) USING (symbol))"""


def days_before(day, n):
    return (date.fromisoformat(day) - timedelta(days=n)).isoformat()


def period_moves(spark, sf, daily):
    names = table(spark, sf, "part").select(F.col("p_brand").alias("symbol"))
    return dg.moves(names, daily, F.lit(DIG_END).cast("date"), DIG_DAYS)


@query("dg_moves", f"WITH {BARS}, {MOVES} SELECT symbol, round(a, 6) AS start_price, round(b, 6) AS end_price, round((b - a) / a * 100, 6) AS change_pct, unavailable FROM mv")
def _(spark, sf):
    return rounded(period_moves(spark, sf, closes(spark, sf, days_before(DIG_END, DIG_DAYS), DIG_END)))


FIRED = f"""{BANDS_CTE}, {BREAKS}, fired AS (SELECT * FROM (SELECT * FROM es UNION ALL SELECT * FROM em UNION ALL SELECT * FROM breaks) WHERE ts >= TIMESTAMP '{DIG_END}' - INTERVAL {DIG_DAYS} DAY AND ts < TIMESTAMP '{DIG_END}')"""


@query("dg_fired_alerts", f"""WITH {BARS}, {SMA_CTE}, {MACD_CTE}, {flips('es', 'sma', 'close', 'sma_20', 'sma')}, {flips('em', 'macd', 'macd_line', 'macd_signal', 'macd')}, {FIRED} SELECT symbol, ts, indicator, kind FROM fired""")
def _(spark, sf):
    end = F.lit(DIG_END).cast("timestamp_ntz")
    history = dg.fired_since(indicator_events(staged_closes(spark, sf)), end - F.expr(f"INTERVAL {DIG_DAYS} DAYS")).where(F.col("ts") < end)
    return history.select("symbol", "ts", "indicator", "kind")


@query("dg_digest", f"""WITH {WIDE_SQL}, {SNAP}, {STATE}, {OWNERS}, {MOVES}, {FIRED}, f AS (SELECT symbol, count(*) AS f FROM fired GROUP BY symbol), b AS (SELECT owner, symbol, count(*) AS b FROM br GROUP BY ALL),
  j AS (SELECT owner, symbol, CASE WHEN unavailable IS NULL THEN (mv.b - a) / a * 100 END AS ch, f, b.b AS nb FROM wl_ LEFT JOIN mv USING (symbol) LEFT JOIN f USING (symbol) LEFT JOIN b USING (owner, symbol)),
  g AS (SELECT owner, count(*) AS symbols, count(ch) AS priced, coalesce(sum(f), 0)::BIGINT AS alerts, coalesce(sum(nb), 0)::BIGINT AS breaches, arg_max(symbol, {{'a': abs(ch), 's': symbol}}) FILTER (ch IS NOT NULL) AS top_symbol, arg_max(ch, {{'a': abs(ch), 's': symbol}}) FILTER (ch IS NOT NULL) AS top_pct FROM j GROUP BY owner)
  SELECT owner, symbols, priced, alerts, breaches, top_symbol, round(top_pct, 6) AS top_pct, CASE WHEN alerts > 0 THEN alerts || CASE WHEN alerts = 1 THEN ' alert fired' ELSE ' alerts fired' END WHEN breaches > 0 THEN breaches || CASE WHEN breaches = 1 THEN ' risk threshold breached' ELSE ' risk thresholds breached' END
    WHEN top_pct IS NOT NULL THEN top_symbol || format(' {{:+.1f}}%', top_pct) ELSE 'no material movement' END AS headline FROM g""")
def _(spark, sf):
    daily = staged_closes(spark, sf)
    end = F.lit(DIG_END).cast("timestamp_ntz")
    fired = dg.fired_since(indicator_events(daily), end - F.expr(f"INTERVAL {DIG_DAYS} DAYS")).where(F.col("ts") < end)
    moved = period_moves(spark, sf, closes(spark, sf, days_before(DIG_END, DIG_DAYS), DIG_END))
    return rounded(dg.build(watch_lists(spark, sf), moved, fired, owner_breaches(spark, sf, daily)))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
LINE = f"""l AS (SELECT symbol, arg_max(close, ts) AS price FROM bars GROUP BY symbol), t AS (SELECT portfolio, sum(shares * price) AS mv FROM lots JOIN l USING (symbol) GROUP BY portfolio),
  m AS (SELECT portfolio, (arg_max(bench, ts) / arg_min(bench, ts) - 1) * 100 AS bp FROM series JOIN bench USING (ts) GROUP BY portfolio),
  pline AS MATERIALIZED (SELECT portfolio, format('value {{:.0f}}; time-weighted {{:+.2f}}%; vs benchmark {{:+.2f}}%', mv, twr_pct, twr_pct - bp) AS line FROM t JOIN twr USING (portfolio) JOIN m USING (portfolio))"""
_HELD = VALUE.replace("st AS (SELECT portfolio", "pst AS (SELECT portfolio").replace("JOIN st USING (portfolio)", "JOIN pst USING (portfolio)")
_PARTS = WIDE_SQL.split(f"{RETURNS}, ", 1)[1]


@query("dg_complete_digest", f"""{_HELD}, {TWR}, {LINE}, {RETS}, {_PARTS}, {SNAP}, {STATE}, {OWNERS}, {MOVES}, {FIRED}, f AS (SELECT symbol, count(*) AS f FROM fired GROUP BY symbol), b AS (SELECT owner, symbol, count(*) AS b FROM br GROUP BY ALL),
  j AS (SELECT owner, symbol, CASE WHEN unavailable IS NULL THEN (mv.b - a) / a * 100 END AS ch, f, b.b AS nb FROM wl_ LEFT JOIN mv USING (symbol) LEFT JOIN f USING (symbol) LEFT JOIN b USING (owner, symbol) WHERE owner <> 'NATION_3'),
  g AS (SELECT owner, count(*) AS symbols, count(ch) AS priced, coalesce(sum(f), 0)::BIGINT AS alerts, coalesce(sum(nb), 0)::BIGINT AS breaches, arg_max(symbol, {{'a': abs(ch), 's': symbol}}) FILTER (ch IS NOT NULL) AS top_symbol, arg_max(ch, {{'a': abs(ch), 's': symbol}}) FILTER (ch IS NOT NULL) AS top_pct FROM j GROUP BY owner),
  o AS (SELECT n_name AS owner, n_nationkey % 4 <> 1 AS pw, n_nationkey % 3 <> 0 AS pa, n_nationkey % 5 <> 2 AS pr, [{', '.join(repr(x) for x in SEGMENTS)}][n_nationkey % 6 + 1] AS portfolio FROM nation),
  z AS (SELECT owner, pw, coalesce(symbols, 0) AS symbols, CASE WHEN pw THEN coalesce(priced, 0) ELSE 0 END AS priced, CASE WHEN pa THEN coalesce(alerts, 0) ELSE 0 END AS alerts, CASE WHEN pr THEN coalesce(breaches, 0) ELSE 0 END AS breaches,
    CASE WHEN pw THEN top_symbol END AS top_symbol, CASE WHEN pw THEN top_pct END AS top_pct, coalesce(line, '') AS portfolio_line FROM o LEFT JOIN g USING (owner) LEFT JOIN pline USING (portfolio))
  SELECT owner, symbols, priced, alerts, breaches, top_symbol, round(top_pct, 6) AS top_pct, portfolio_line, CASE WHEN alerts > 0 THEN alerts || CASE WHEN alerts = 1 THEN ' alert fired' ELSE ' alerts fired' END WHEN breaches > 0 THEN breaches || CASE WHEN breaches = 1 THEN ' risk threshold breached' ELSE ' risk thresholds breached' END
    WHEN top_pct IS NOT NULL THEN top_symbol || format(' {{:+.1f}}%', top_pct) ELSE 'no material movement' END AS headline,
    concat_ws('; ', CASE WHEN pw AND symbols = 0 THEN 'nothing on the watch list' END, CASE WHEN portfolio_line = '' THEN 'no holdings, watch list only' END) AS notes FROM z""")
def _(spark, sf):
    """Owners choose the parts of their digest; one has no watch list, some have no holdings."""
    daily = staged_closes(spark, sf)
    end = F.lit(DIG_END).cast("timestamp_ntz")
    fired = dg.fired_since(indicator_events(daily), end - F.expr(f"INTERVAL {DIG_DAYS} DAYS")).where(F.col("ts") < end)
    moved = period_moves(spark, sf, closes(spark, sf, days_before(DIG_END, DIG_DAYS), DIG_END))
    k = F.col("n_nationkey")
    owners = table(spark, sf, "nation").select(
        F.col("n_name").alias("owner"), (k % 4 != 1).alias("watchlist"), (k % 3 != 0).alias("alerts"), (k % 5 != 2).alias("risk"),
        F.get(F.array(*[F.lit(x) for x in SEGMENTS]), (k % 6).cast("int")).alias("portfolio"))
    lists = watch_lists(spark, sf).where("owner <> 'NATION_3'")
    lines = dg.portfolio_line(ph.performance(staged_lots(spark, sf), daily, benchmark(daily), F.lit(END).cast("date")))
    return rounded(dg.build_complete(owners, lists, moved, fired, owner_breaches(spark, sf, daily), lines))


@query("dg_is_due", """WITH s AS (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not a date' ELSE strftime(TIMESTAMP '2001-06-01' + INTERVAL (c_custkey % 40) DAY, '%Y-%m-%d %H:%M:%S') END AS last_sent, 1 + c_custkey % 14 AS period FROM customer)
  SELECT user_id, coalesce(epoch_us(TIMESTAMP '2001-06-30') - epoch_us(try_cast(last_sent AS TIMESTAMP)) >= period * 86400000000, true) AS due FROM s""")
def _(spark, sf):
    k = F.col("c_custkey")
    stamp = F.date_format(F.timestamp_seconds(F.lit(991353600) + (k % 40) * 86400), "yyyy-MM-dd HH:mm:ss")
    last = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "not a date").otherwise(stamp)
    return table(spark, sf, "customer").select(k.alias("user_id"), dg.is_due(last, F.lit("2001-06-30").cast("timestamp_ntz"), 1 + k % 14).alias("due"))


@query("dg_portfolio_line", f"""{VALUE}, {TWR}, l AS (SELECT symbol, arg_max(close, ts) AS price FROM bars GROUP BY symbol), t AS (SELECT portfolio, sum(shares * price) AS mv FROM lots JOIN l USING (symbol) GROUP BY portfolio),
  m AS (SELECT portfolio, (arg_max(bench, ts) / arg_min(bench, ts) - 1) * 100 AS bp FROM series JOIN bench USING (ts) GROUP BY portfolio)
  SELECT portfolio, format('value {{:.0f}}; time-weighted {{:+.2f}}%; vs benchmark {{:+.2f}}%', mv, twr_pct, twr_pct - bp) AS line FROM t JOIN twr USING (portfolio) JOIN m USING (portfolio)""")
def _(spark, sf):
    daily = staged_closes(spark, sf)
    return dg.portfolio_line(ph.performance(staged_lots(spark, sf), daily, benchmark(daily), F.lit(END).cast("date")))


def flag_state(spark, sf):
    """Everything the flag list reads, one row per brand."""
    daily = staged_closes(spark, sf)
    base = rk.risk_score(fa.dcf(fa.company_quality(fa.scorecard(full_metrics(spark, sf, daily))), GROWTH))
    recent = recent_events(indicator_events(daily), daily)
    kind = lambda i: F.max_by("kind", F.when(F.col("indicator") == i, F.col("ts")))
    kinds = recent.groupBy("symbol").agg(kind("sma").alias("sma_kind"), kind("macd").alias("macd_kind"), kind("bollinger").alias("band_kind"))
    fear = bars(event_ticks(spark, sf).where(F.col("symbol") == "error"), "day")
    return base.join(kinds, "symbol", "left").crossJoin(F.broadcast(rk.macro_flag(fear).select("macro_flag")))


_BANDS = {n: (b, w) for n, b, w, _ in P.RISK_FACTORS}


def _flag_sql():
    rows = [("alignment = 'high'", "strength", 3, "Fundamentals", "high scorecard alignment"), ("alignment = 'low'", "concern", 3, "Fundamentals", "low scorecard alignment")]
    for m in P.SCORE_WEIGHTS:
        rows += [(f"pass_{m}", "strength", 1, "Fundamentals", f"{m} meets its benchmark"), (f"NOT pass_{m}", "concern", 1, "Fundamentals", f"{m} misses its benchmark")]
    rows += [("quality >= 70", "strength", 3, "Fundamentals", "high quality classification"), ("quality < 50", "concern", 3, "Fundamentals", "weak quality classification"),
             ("altman_z > 2.99", "strength", 3, "Risk", "distress score in the safe zone"), ("altman_z < 1.81", "concern", 3, "Risk", "distress score in the distress zone"),
             ("risk_score >= 75", "strength", 3, "Risk", "favourable composite risk score"), ("risk_score < 50", "concern", 3, "Risk", "weak composite risk score")]
    for n, (b, w) in _BANDS.items():
        sub = f"greatest(0, least(1, ({n} - ({w})) / (({b}) - ({w}))))::DOUBLE * 100"
        rows += [(f"{n} IS NOT NULL AND {sub} >= 70", "strength", 2, "Risk", f"{n} is a strong factor"), (f"{n} IS NOT NULL AND {sub} < 40", "concern", 2, "Risk", f"{n} is a weak factor")]
    rows += [("safety_pct > 0", "strength", 2, "Valuation", "priced below intrinsic value"), ("safety_pct <= 0", "concern", 2, "Valuation", "priced above intrinsic value"),
             ("max_drawdown <= -0.30", "concern", 2, "Risk", "deep drawdown"), ("max_drawdown >= -0.10", "strength", 2, "Risk", "shallow drawdown"), ("macro", "concern", 1, "Macro", "high-fear market regime"),
             ("rsi <= 30", "strength", 2, "Technical", "oversold"), ("rsi >= 70", "concern", 2, "Technical", "overbought"), ("sma_kind = 'bullish'", "strength", 1, "Technical", "recent bullish SMA crossover"),
             ("sma_kind = 'bearish'", "concern", 1, "Technical", "recent bearish SMA crossover"), ("macd_kind = 'bullish'", "strength", 1, "Technical", "recent bullish MACD crossover"),
             ("macd_kind = 'bearish'", "concern", 1, "Technical", "recent bearish MACD crossover"), ("band_kind = 'lower'", "strength", 1, "Technical", "recent break below the lower band"), ("band_kind = 'upper'", "concern", 1, "Technical", "recent break above the upper band")]
    return " UNION ALL ".join(f"SELECT symbol, {i}::BIGINT AS pos, '{d}' AS direction, {s} AS severity, '{c}' AS category, '{t}' AS text FROM fs WHERE {q}" for i, (q, d, s, c, t) in enumerate(rows))


FLAG_STATE = f"""{WIDE_SQL}, {SCORE.replace('FROM an)', 'FROM wide)', 1)}, {QUALITY.replace('FROM an)', 'FROM card)', 1)}, dg AS (SELECT * FROM quality), {DCF.replace('dg AS (SELECT *,', 'dgx AS (SELECT *,', 1).replace('FROM an)', 'FROM dg)', 1).replace('FROM dg), dcf', 'FROM dgx), dcf').replace('END AS intrinsic FROM dg)', 'END AS intrinsic FROM dgx)')},
  {SMA_CTE}, {MACD_CTE}, {flips('es', 'sma', 'close', 'sma_20', 'sma')}, {flips('em', 'macd', 'macd_line', 'macd_signal', 'macd')}, {BANDS_CTE}, {BREAKS},
  cutd AS (SELECT symbol, min(ts) AS c FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) WHERE r <= 10 GROUP BY symbol),
  rk_ AS (SELECT symbol, arg_max(kind, ts) FILTER (indicator = 'sma') AS sma_kind, arg_max(kind, ts) FILTER (indicator = 'macd') AS macd_kind, arg_max(kind, ts) FILTER (indicator = 'bollinger') AS band_kind
    FROM (SELECT * FROM es UNION ALL SELECT * FROM em UNION ALL SELECT * FROM breaks) JOIN cutd USING (symbol) WHERE ts >= c GROUP BY symbol),
  fr AS (SELECT arg_max(100 + 0.5 * sqrt(value), epoch_us(ts) % 86400000000 * 67108864 + event_id % 67108864) > 25 AS macro FROM events WHERE event_type = 'error' AND ts >= (SELECT date_trunc('day', max(ts)) FROM events WHERE event_type = 'error')),
  fs AS MATERIALIZED (SELECT dcf.*, {RISK_SCORE} AS risk_score, CASE WHEN score_pct >= 75 THEN 'high' WHEN score_pct >= 40 THEN 'moderate' ELSE 'low' END AS alignment, sma_kind, macd_kind, band_kind, macro FROM dcf LEFT JOIN rk_ USING (symbol), fr)"""


@query("xd_top_flags", f"WITH {FLAG_STATE}, fl AS ({_flag_sql()}) SELECT symbol, pos, direction, severity, category, text, row_number() OVER (PARTITION BY symbol, direction ORDER BY severity DESC, pos) AS rank FROM fl QUALIFY rank <= 3")
def _(spark, sf):
    return dg.top_flags(dg.flags(flag_state(spark, sf)))


_CALM = """CASE WHEN safety_pct IS NULL THEN 'NO VALUATION' WHEN score_pct >= 75 AND safety_pct > -30 THEN 'STRONG BUY' WHEN score_pct >= 75 THEN 'HOLD (PREMIUM)'
    WHEN score_pct >= 50 AND safety_pct > -25 THEN 'HOLD / WATCHLIST' ELSE 'AVOID' END"""
MACRO = """(SELECT arg_max(100 + 0.5 * sqrt(value), epoch_us(ts) % 86400000000 * 67108864 + event_id % 67108864) > 25 FROM events WHERE event_type = 'error' AND ts >= (SELECT date_trunc('day', max(ts)) FROM events WHERE event_type = 'error'))"""


@query("xd_verdict", f"""WITH {ANALYZED}, {SCORE.replace('FROM an)', 'FROM an)')}, {DCF.replace('FROM an)', 'FROM card)', 1)}
  SELECT symbol, round(score_pct, 4) AS score_pct, round(safety_pct, 4) AS safety_pct, {DCF_STATUS} AS dcf_status, CASE WHEN {MACRO} THEN 'STRONG AVOID' ELSE {_CALM} END AS verdict, {_CALM} AS calm_verdict FROM dcf""")
def _(spark, sf):
    out = fa.dcf(fa.scorecard(analyzed(spark, sf)), GROWTH)
    fear = bars(event_ticks(spark, sf).where(F.col("symbol") == "error"), "day")
    both = out.crossJoin(F.broadcast(rk.macro_flag(fear).select("macro_flag")))  # one row
    v = lambda macro: dg.verdict(F.col("score_pct"), F.col("safety_pct"), macro)
    return rounded(both.select("symbol", "score_pct", "safety_pct", "dcf_status", v(F.col("macro_flag")).alias("verdict"), v(F.lit(False)).alias("calm_verdict")), 4)


_VIEW = ("gross_margin_pct", "operating_margin_pct", "net_margin_pct", "roa_pct", "roe_pct", "roic_pct", "current_ratio_computed", "quick_ratio_computed", "interest_coverage", "altman_z", "pe_computed", "pb_computed", "ev_ebitda", "fcf_yield_pct")


@query("xd_fundamentals_view", f"WITH {ANALYZED}, {SCORE} SELECT symbol, sector, CASE WHEN score_pct >= 75 THEN 'high' WHEN score_pct >= 40 THEN 'moderate' ELSE 'low' END AS alignment, round(score_pct, 1) AS score_pct, {', '.join(f'round({c}, 2) AS {c}' for c in _VIEW)} FROM card")
def _(spark, sf):
    return dg.fundamentals_view(fa.scorecard(analyzed(spark, sf)))


VIEW_END = "2001-06-30"
_P = lambda c: f"CASE WHEN c.bars >= 30 THEN round({c} * 100, 2) END"


@query("xd_risk_view", f"""WITH {BARS.replace('bars AS MATERIALIZED', 'bars0 AS MATERIALIZED')}, bars AS MATERIALIZED (SELECT * FROM bars0 WHERE ts::DATE >= DATE '{VIEW_END}' - 365 AND ts::DATE < DATE '{VIEW_END}'), {RETS}, {PERF}, {tail_sql(0.95, 10**9)}, {drawdown_sql('bars')}
  SELECT symbol, 365::BIGINT AS window_days, c.bars AS observations, {_P('ann_return')} AS annualized_return_pct, {_P('ann_vol')} AS annualized_volatility_pct, CASE WHEN c.bars >= 30 THEN round(sharpe, 2) END AS sharpe_ratio,
    CASE WHEN c.bars >= 30 THEN round(sortino, 2) END AS sortino_ratio, {_P('hist_var')} AS historical_var_pct, {_P('expected_shortfall')} AS expected_shortfall_pct, {_P('max_drawdown')} AS max_drawdown_pct,
    CASE WHEN c.bars < 30 THEN 'only ' || c.bars || ' bars: too few to annualize from' END AS refusal
  FROM (SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol) c JOIN perf USING (symbol) JOIN tail USING (symbol) JOIN mdd USING (symbol)""")
def _(spark, sf):
    return dg.risk_view(staged_closes(spark, sf, days_before(VIEW_END, dg.DEFAULT_DAYS), VIEW_END), VIEW_END)


@query("risk_snapshot", f"""WITH {WIDE_SQL} SELECT symbol, {RISK_SCORE} AS risk_score, CASE WHEN {RISK_SCORE} >= 75 THEN 'low risk' WHEN {RISK_SCORE} >= 50 THEN 'moderate risk' WHEN {RISK_SCORE} >= 30 THEN 'elevated risk' ELSE 'high risk' END AS risk_grade,
  ({' + '.join(f'({n} IS NOT NULL)::INT' for n, *_ in P.RISK_FACTORS)})::BIGINT AS factors, concat_ws(', ', {', '.join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n, *_ in P.RISK_FACTORS)}) AS excluded,
  round(altman_z, 5) AS altman_z, round(rolling_vol, 5) AS rolling_vol, round(hist_var, 6) AS hist_var, round(expected_shortfall, 6) AS expected_shortfall, round(max_drawdown, 6) AS max_drawdown FROM wide""")
def _(spark, sf):
    out = rk.risk_score(risk_inputs(spark, sf))
    return rounded(out.select("symbol", "risk_score", "risk_grade", "factors", "excluded", "altman_z", "rolling_vol", "hist_var", "expected_shortfall", "max_drawdown"),
                   6, altman_z=5, rolling_vol=5)
