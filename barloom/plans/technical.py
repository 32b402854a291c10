"""Bars, indicators, and their events."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import params as P
from barloom.functions.series import bands, rounded
from barloom.operators import events as ev
from barloom.operators import indicators as ti
from barloom.operators.backtest import event_kind
from barloom.plans.base_sql import (
    BANDS_CTE, BARS, BENCH, BREAKS, EVENTS_CTE, HOURLY, MACD_CTE, RSI_CTE, SMA_CTE, flips, full, recur, seeded,
)
from barloom.plans.registry import query
from barloom.session import stage
from barloom.sources.bars import bars_from_bars
from barloom.sources.market import bars_daily, bars_hourly, benchmark

KEYED = ("symbol", "ts")


@query("bars_daily", f"WITH {BARS} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high,"
       " round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars")
def _(spark, sf):
    return rounded(bars_daily(spark, sf))


@query("bars_hourly", f"WITH {HOURLY} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high,"
       " round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM hourly")
def _(spark, sf):
    return rounded(bars_hourly(spark, sf))


@query("bars_monthly", f"""WITH {BARS} SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS ts,
  round(arg_min(open, ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low,
  round(arg_max(close, ts), 6) AS close, round(sum(volume), 6) AS volume FROM bars GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(bars_from_bars(bars_daily(spark, sf), "month"))


@query("ind_sma_trio", f"WITH {BARS} SELECT symbol, ts, round({full('avg', 'close', 20)}, 6) AS sma_20,"
       f" round({full('avg', 'close', 50)}, 6) AS sma_50, round({full('avg', 'close', 200)}, 6) AS sma_200 FROM bars")
def _(spark, sf):
    out = ti.sma(bars_daily(spark, sf).select("symbol", "ts", "close"), P.SMA_TRIO)
    return rounded(out.drop("close"))


@query("ind_bollinger_zscore", f"""WITH {BARS}, {BANDS_CTE} SELECT symbol, ts, round(bb_middle, 6) AS bb_middle,
  round(bb_upper, 6) AS bb_upper, round(bb_lower, 6) AS bb_lower, round(zscore, 6) AS zscore FROM bands""")
def _(spark, sf):
    out = ti.zscore(ti.bollinger(bars_daily(spark, sf).select("symbol", "ts", "close")))
    return rounded(out.drop("close"))


@query("ind_rsi", f"""WITH {BARS}, {RSI_CTE} SELECT symbol, ts, round(rsi, 5) AS rsi,
  CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' WHEN rsi IS NOT NULL THEN 'neutral' END AS zone FROM rsi""")
def _(spark, sf):
    out = ti.rsi(bars_daily(spark, sf).select("symbol", "ts", "close"))
    return rounded(out.withColumn("zone", ti.rsi_zone(F.col("rsi"))).drop("close"), 5)


@query("ind_macd", f"""WITH {BARS}, {MACD_CTE} SELECT symbol, ts, round(macd_line, 5) AS macd_line,
  round(macd_signal, 5) AS macd_signal, round(macd_hist, 5) AS macd_hist FROM macd""")
def _(spark, sf):
    return rounded(ti.macd(bars_daily(spark, sf).select("symbol", "ts", "close")).drop("close"), 5)


TR = """tr AS MATERIALIZED (SELECT symbol, ts, close, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, pc
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars))"""


@query("ind_atr_stop", f"""WITH {BARS}, {TR}, {seeded('t0', 'tr', 'tr', 14)}, {recur('t1', 't0', {'y': ('tr', 1 / 14)})}
  SELECT tr.symbol, tr.ts, round(tr, 5) AS true_range, round(y, 5) AS atr, round(close - 2 * y, 5) AS stop
  FROM tr LEFT JOIN t1 USING (symbol, ts)""")
def _(spark, sf):
    out = ti.atr(bars_daily(spark, sf))
    out = out.withColumn("stop", ti.stop_loss(F.col("close"), F.col("atr")))
    return rounded(out.select("symbol", "ts", "true_range", "atr", "stop"), 5)


STOCH = f"""st1 AS (SELECT symbol, ts, close, 100 * (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) AS raw FROM bars),
st2 AS (SELECT *, {full('avg', 'raw', 3)} AS stoch_k FROM st1),
stoch AS MATERIALIZED (SELECT symbol, ts, close, stoch_k, {full('avg', 'stoch_k', 3)} AS stoch_d FROM st2)"""


@query("ind_stochastic", f"""WITH {BARS}, {STOCH} SELECT symbol, ts, round(stoch_k, 6) AS stoch_k, round(stoch_d, 6) AS stoch_d,
  CASE WHEN stoch_k >= 80 THEN 'overbought' WHEN stoch_k <= 20 THEN 'oversold' WHEN stoch_k IS NOT NULL THEN 'neutral' END AS zone FROM stoch""")
def _(spark, sf):
    out = ti.stochastic(bars_daily(spark, sf))
    out = out.withColumn("zone", ti.level_zone(F.col("stoch_k"), P.STOCH_OVERBOUGHT, P.STOCH_OVERSOLD))
    return rounded(out.select("symbol", "ts", "stoch_k", "stoch_d", "zone"))


@query("ind_anchored_vwap", f"""WITH {BARS} SELECT symbol, ts,
  round(sum(CASE WHEN ts >= TIMESTAMP '1997-06-02' THEN (high + low + close) / 3 * volume END) OVER w
      / sum(CASE WHEN ts >= TIMESTAMP '1997-06-02' THEN volume END) OVER w, 6) AS vwap
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, sf):
    anchor = F.lit("1997-06-02").cast("timestamp_ntz")
    return rounded(ti.anchored_vwap(bars_daily(spark, sf), anchor).select("symbol", "ts", "vwap"))


@query("ind_adx", f"""WITH {BARS}, mv AS MATERIALIZED (
  SELECT symbol, ts, rn, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm,
         CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm
  FROM (SELECT symbol, ts, row_number() OVER w - 1 AS rn, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down,
               greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, lag(close) OVER w AS pc
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE pc IS NOT NULL),
  {recur('dm', 'mv', {'p': ('pdm', 1 / 14), 'm': ('mdm', 1 / 14)})},
  a0 AS MATERIALIZED (SELECT symbol, ts, rn - 12 AS rn, CASE WHEN rn = 13 THEN
       avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) ELSE tr END AS tr FROM mv QUALIFY rn - 12 >= 1),
  {recur('a1', 'a0', {'a': ('tr', 1 / 14)})},
  di AS MATERIALIZED (SELECT dm.symbol, dm.ts, a1.rn, 100 / a * p AS plus_di, 100 / a * m AS minus_di FROM dm JOIN a1 USING (symbol, ts)),
  dx AS MATERIALIZED (SELECT symbol, ts, rn, 100 * abs(plus_di - minus_di) / (plus_di + minus_di) AS dx FROM di),
  {recur('ax', 'dx', {'adx': ('dx', 1 / 14)})}
  SELECT b.symbol, b.ts, round(plus_di, 5) AS plus_di, round(minus_di, 5) AS minus_di, round(adx, 5) AS adx, CASE WHEN adx >= 25 THEN 'trending' WHEN adx IS NOT NULL THEN 'ranging' END AS trend
  FROM bars b LEFT JOIN di USING (symbol, ts) LEFT JOIN ax USING (symbol, ts)""")
def _(spark, sf):
    out = ti.adx(bars_daily(spark, sf)).withColumn("trend", bands(F.col("adx"), [(">=", P.ADX_TREND, "trending")], "ranging"))
    return rounded(out.select("symbol", "ts", "plus_di", "minus_di", "adx", "trend"), 5)


def _mid(n):
    return f"({full('max', 'high', n)} + {full('min', 'low', n)}) / 2"


@query("ind_ichimoku", f"""WITH {BARS}, m AS (SELECT symbol, ts, close, {_mid(9)} AS t, {_mid(26)} AS k, {_mid(52)} AS b FROM bars)
  SELECT symbol, ts, round(t, 6) AS tenkan, round(k, 6) AS kijun, round(lag((t + k) / 2, 25) OVER w, 6) AS senkou_a,
  round(lag(b, 25) OVER w, 6) AS senkou_b, round(lead(close, 25) OVER w, 6) AS chikou
  FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, sf):
    out = ti.ichimoku(bars_daily(spark, sf))
    return rounded(out.select("symbol", "ts", "tenkan", "kijun", "senkou_a", "senkou_b", "chikou"))


@query("ind_ichimoku_forward", f"""WITH {BARS}, m AS (SELECT symbol, ts, {_mid(9)} AS t, {_mid(26)} AS k, {_mid(52)} AS b,
    row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, max(ts) OVER (PARTITION BY symbol) AS last_ts FROM bars),
  f AS (SELECT symbol, 27 - back AS step, last_ts, lead((t + k) / 2) OVER w AS a, lead(b) OVER w AS b FROM m WHERE back <= 26
        WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  d AS (SELECT symbol, d::TIMESTAMP AS d, row_number() OVER (PARTITION BY symbol ORDER BY d) AS step
        FROM (SELECT symbol, unnest(generate_series(max(ts) + INTERVAL 1 DAY, max(ts) + INTERVAL 60 DAY, INTERVAL 1 DAY)) AS d FROM bars GROUP BY symbol)
        WHERE isodow(d) < 6)
  SELECT f.symbol, d.d AS ts, f.step::BIGINT AS step, round(a, 6) AS senkou_a, round(b, 6) AS senkou_b FROM f JOIN d ON f.symbol = d.symbol AND f.step = d.step""")
def _(spark, sf):
    return rounded(ti.ichimoku_forward(bars_daily(spark, sf)))


@query("ind_obv", f"""WITH {BARS} SELECT symbol, ts, round(sum(s * volume) OVER (PARTITION BY symbol ORDER BY ts), 6) AS obv
  FROM (SELECT symbol, ts, volume, sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS s FROM bars)""")
def _(spark, sf):
    return rounded(ti.obv(bars_daily(spark, sf)).select("symbol", "ts", "obv"))


@query("ind_relative_return", f"""WITH {BARS}{BENCH} SELECT symbol, ts, round((close / first_value(close) OVER w - 1) * 100, 6) AS cum_pct,
  round((bench / first_value(bench) OVER w - 1) * 100, 6) AS bench_pct,
  round((close / first_value(close) OVER w - 1) * 100 - (bench / first_value(bench) OVER w - 1) * 100, 6) AS alpha_pct
  FROM bars JOIN bench USING (ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, sf):
    daily = bars_daily(spark, sf).select("symbol", "ts", "close")
    out = ti.relative_return(daily, benchmark(daily))
    return rounded(out.select("symbol", "ts", "cum_pct", "bench_pct", "alpha_pct"))


def _ev_sql(name):
    return f"SELECT symbol, ts, indicator, kind, round(price, 5) AS price, round(level, 5) AS level FROM {name}"


def sma_events(daily):
    return ev.crossings(ti.sma(daily, [P.SMA_DEFAULT]), "close", f"sma_{P.SMA_DEFAULT}", "sma")


def macd_events(daily):
    return ev.crossings(ti.macd(daily), "macd_line", "macd_signal", "macd")


def bollinger_events(daily):
    return ev.breakouts(ti.bollinger(daily))


def indicator_events(daily):
    """SMA, MACD and Bollinger events of every symbol, read off one indicator frame (no union of branches)."""
    sma = f"sma_{P.SMA_DEFAULT}"
    frame = ti.bollinger(ti.sma(ti.macd(daily), [P.SMA_DEFAULT]))
    frame = frame.withColumns({f"_{i}": event_kind(i) for i in ("sma_cross", "macd_cross", "bollinger_breakout")})
    band = F.col("_bollinger_breakout")

    def fired(name, kind, level):
        return F.when(kind.isNotNull(), F.struct(F.lit(name).alias("indicator"), kind.alias("kind"), F.col("close").alias("price"), level.alias("level")))

    found = F.array_compact(F.array(
        fired("sma", F.col("_sma_cross"), F.col(sma)), fired("macd", F.col("_macd_cross"), F.col("macd_signal")),
        fired("bollinger", F.when(band != "inside", band), F.when(band == "upper", F.col("bb_upper")).otherwise(F.col("bb_lower")))))
    return frame.select("symbol", "ts", F.explode(found).alias("e")).select("symbol", "ts", "e.*")


def closes(spark, sf):
    return bars_daily(spark, sf).select("symbol", "ts", "close")


@query("events_sma", f"WITH {BARS}, {SMA_CTE}, {flips('e', 'sma', 'close', 'sma_20', 'sma')} {_ev_sql('e')}")
def _(spark, sf):
    return rounded(sma_events(closes(spark, sf)), 5)


@query("events_macd", f"WITH {BARS}, {MACD_CTE}, {flips('e', 'macd', 'macd_line', 'macd_signal', 'macd')} {_ev_sql('e')}")
def _(spark, sf):
    return rounded(macd_events(closes(spark, sf)), 5)


@query("events_stochastic", f"WITH {BARS}, {STOCH}, {flips('e', 'stoch', 'stoch_k', 'stoch_d', 'stochastic')} {_ev_sql('e')}")
def _(spark, sf):
    frame = ti.stochastic(bars_daily(spark, sf))
    return rounded(ev.crossings(frame, "stoch_k", "stoch_d", "stochastic"), 5)


@query("events_bollinger", f"WITH {BARS}, {BANDS_CTE}, {BREAKS} {_ev_sql('breaks')}")
def _(spark, sf):
    return rounded(bollinger_events(closes(spark, sf)), 5)


@query("events_newest", f"""WITH {BARS}, {EVENTS_CTE} SELECT symbol, ts, indicator, kind, round(price, 5) AS price, round(level, 5) AS level,
  row_number() OVER (PARTITION BY symbol, indicator ORDER BY ts DESC, kind) AS rank FROM evs QUALIFY rank <= 10""")
def _(spark, sf):
    return rounded(ev.newest_events(indicator_events(stage(closes(spark, sf)))), 5)


@query("events_recent", f"""WITH {BARS}, {EVENTS_CTE}, cut AS (SELECT symbol, min(ts) AS cut FROM (
    SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) WHERE r <= 10 GROUP BY symbol)
  SELECT evs.symbol, ts, indicator, kind, round(price, 5) AS price, round(level, 5) AS level FROM evs JOIN cut USING (symbol) WHERE ts >= cut""")
def _(spark, sf):
    daily = stage(closes(spark, sf))
    return rounded(ev.recent_events(indicator_events(daily), daily), 5)
