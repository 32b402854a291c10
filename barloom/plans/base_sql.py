"""SQL fragments that repeat the table derivations of ``barloom.sources``."""

TICKS = """
ticks AS (
  SELECT p_brand AS symbol, l_shipdate AS ts,
         l_orderkey * 8192 + l_linenumber * 1024 + l_partkey % 1024 AS seq,
         100 + 0.05 * sqrt(l_extendedprice / l_quantity) AS price, l_quantity AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0)"""
FROM_TICKS = """
bars AS MATERIALIZED (
  SELECT symbol, ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(qty) AS volume
  FROM ticks GROUP BY symbol, ts)
"""
BARS = f"{TICKS}, {FROM_TICKS}"

HOURLY = """
eticks AS (
  SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, epoch_us(ts) % 86400000000 * 67108864 + event_id % 67108864 AS seq,
         100 + 0.5 * sqrt(value) AS price, 1.0::DOUBLE AS qty
  FROM events),
hourly AS MATERIALIZED (
  SELECT symbol, ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(qty) AS volume
  FROM eticks GROUP BY symbol, ts)
"""

RETS = """
rets AS MATERIALIZED (
  SELECT symbol, ts, close, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM bars)
"""
RETURNS = f"{BARS}, {RETS}"
BENCH = ", bench AS MATERIALIZED (SELECT ts, avg(close) AS bench FROM bars GROUP BY ts)"


def recur(name: str, src: str, cols: dict[str, tuple[str, float]]) -> str:
    """Smoothing spelled as a recursion; ``src`` has (symbol, ts, rn) with rn = 1 at the first value of a series."""
    first = ", ".join(f"{x} AS {out}" for out, (x, _) in cols.items())
    step = ", ".join(f"{1 - a!r} * r.{out} + {a!r} * s.{x}" for out, (x, a) in cols.items())
    outs = ", ".join(cols)
    return f"""{name} AS (
  WITH RECURSIVE r(symbol, ts, rn, {outs}) AS (
    SELECT symbol, ts, rn, {first} FROM {src} WHERE rn = 1
    UNION ALL
    SELECT s.symbol, s.ts, s.rn, {step} FROM r JOIN {src} s ON s.symbol = r.symbol AND s.rn = r.rn + 1)
  SELECT * FROM r)"""


def seeded(name: str, src: str, x: str, n: int) -> str:
    """Non-null rows of x from the n-th on; the n-th holds the mean of the first n and becomes rn = 1."""
    return f"""{name} AS MATERIALIZED (
  SELECT symbol, ts, k - {n - 1} AS rn, CASE WHEN k = {n} THEN m ELSE {x} END AS {x} FROM (
    SELECT symbol, ts, {x}, row_number() OVER w AS k,
           avg({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m
    FROM {src} WHERE {x} IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE k >= {n})"""


def full(agg: str, x: str, n: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


RSI = ["""chg AS MATERIALIZED (
  SELECT symbol, ts, greatest(d, 0) AS gain, greatest(-d, 0) AS loss, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn
  FROM (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars) WHERE d IS NOT NULL)""",
       recur("wl", "chg", {"ag": ("gain", 1 / 14), "al": ("loss", 1 / 14)}),
       """rsi AS MATERIALIZED (
  SELECT b.symbol, b.ts, CASE WHEN rn < 14 THEN NULL WHEN ag = 0 AND al = 0 THEN 50 WHEN al = 0 THEN 100
         ELSE 100 - 100 / (1 + ag / al) END AS rsi
  FROM bars b LEFT JOIN wl USING (symbol, ts))"""]
RSI_CTE = ", ".join(RSI)

MACD_CTE = ", ".join([
    seeded("mc_f0", "bars", "close", 12), recur("mc_f1", "mc_f0", {"y": ("close", 2 / 13)}),
    seeded("mc_s0", "bars", "close", 26), recur("mc_s1", "mc_s0", {"y": ("close", 2 / 27)}),
    "mline AS MATERIALIZED (SELECT mc_f1.symbol, mc_f1.ts, mc_f1.y - mc_s1.y AS line FROM mc_f1 JOIN mc_s1 USING (symbol, ts))",
    seeded("mc_g0", "mline", "line", 9), recur("mc_g1", "mc_g0", {"y": ("line", 2 / 10)}),
    """macd AS MATERIALIZED (SELECT b.symbol, b.ts, b.close, m.line AS macd_line, mc_g1.y AS macd_signal, m.line - mc_g1.y AS macd_hist
  FROM bars b LEFT JOIN mline m USING (symbol, ts) LEFT JOIN mc_g1 USING (symbol, ts))""",
])

BANDS_CTE = f"""bands AS MATERIALIZED (
  SELECT symbol, ts, close, m AS bb_middle, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, (close - m) / nullif(s, 0) AS zscore
  FROM (SELECT symbol, ts, close, {full('avg', 'close', 20)} AS m, {full('stddev_samp', 'close', 20)} AS s FROM bars))"""


def flips(name: str, src: str, a: str, b: str, indicator: str) -> str:
    return f"""{name} AS (
  SELECT symbol, ts, '{indicator}' AS indicator, CASE WHEN up THEN 'bullish' ELSE 'bearish' END AS kind, close AS price, {b} AS level
  FROM (SELECT *, lag(up) OVER (PARTITION BY symbol ORDER BY ts) AS was FROM (
    SELECT symbol, ts, close, {b}, {a} > {b} AS up FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) WHERE up <> was)"""


BREAKS = """breaks AS (
  SELECT symbol, ts, 'bollinger' AS indicator, st AS kind, close AS price, CASE WHEN st = 'upper' THEN bb_upper ELSE bb_lower END AS level
  FROM (SELECT *, lag(st) OVER (PARTITION BY symbol ORDER BY ts) AS was FROM (
    SELECT *, CASE WHEN close > bb_upper THEN 'upper' WHEN close < bb_lower THEN 'lower' ELSE 'inside' END AS st
    FROM bands WHERE bb_upper IS NOT NULL)) WHERE st <> was AND st <> 'inside')"""
SMA_CTE = f"sma AS MATERIALIZED (SELECT symbol, ts, close, {full('avg', 'close', 20)} AS sma_20 FROM bars)"
EVENTS_CTE = ", ".join([
    SMA_CTE, flips("ev_s", "sma", "close", "sma_20", "sma"), MACD_CTE,
    flips("ev_m", "macd", "macd_line", "macd_signal", "macd"), BANDS_CTE, BREAKS,
    "evs AS MATERIALIZED (SELECT * FROM ev_s UNION ALL SELECT * FROM ev_m UNION ALL SELECT * FROM breaks)",
])

MEMBERS = """, mem AS MATERIALIZED (SELECT DISTINCT 'basket' || (regexp_extract(p_brand, '([0-9]+)', 1)::INT % 5) AS basket, p_brand AS symbol,
    (1 + regexp_extract(p_brand, '([0-9]+)', 1)::INT % 3)::DOUBLE AS weight FROM part)"""


def aligned(n: int | None) -> str:
    cut = "" if n is None else f"QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= {n}"
    return f"""{MEMBERS}, arec AS (SELECT symbol, ts, ret FROM rets {cut}),
  aj AS (SELECT basket, symbol, ts, ret FROM arec JOIN mem USING (symbol) WHERE ret IS NOT NULL),
  aligned AS MATERIALIZED (SELECT basket, symbol, ts, ret FROM aj JOIN (SELECT basket, count(DISTINCT symbol) AS size FROM aj GROUP BY basket) USING (basket)
    QUALIFY count(*) OVER (PARTITION BY basket, ts) = size AND size >= 2)"""


PREP = ", ".join([SMA_CTE, MACD_CTE, BANDS_CTE, RSI_CTE, """prep AS MATERIALIZED (
  SELECT b.symbol, b.ts, b.close, sma_20, macd_line, macd_signal, bb_upper, bb_lower, zscore, rsi,
         b.close / lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.ts) - 1 AS r,
         row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) - 1 AS i, count(*) OVER (PARTITION BY b.symbol) AS n
  FROM bars b JOIN sma USING (symbol, ts) JOIN macd USING (symbol, ts) JOIN bands USING (symbol, ts) JOIN rsi USING (symbol, ts)
  QUALIFY n >= 22)"""])


def kinds(src: str, key: str, name: str = "kinds") -> str:
    """Event kinds firing on each bar of each series."""
    w = f"(PARTITION BY {key} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN s1 <> last_value(s1 IGNORE NULLS) OVER {w} THEN s1 END AS s1,
    CASE WHEN s2 <> last_value(s2 IGNORE NULLS) OVER {w} THEN s2 END AS s2, CASE WHEN s3 <> last_value(s3 IGNORE NULLS) OVER {w} THEN s3 END AS s3)
  FROM (SELECT *, CASE WHEN close > sma_20 THEN 'bullish' WHEN close <= sma_20 THEN 'bearish' END AS s1,
    CASE WHEN macd_line > macd_signal THEN 'bullish' WHEN macd_line <= macd_signal THEN 'bearish' END AS s2,
    CASE WHEN close > bb_upper THEN 'upper' WHEN close < bb_lower THEN 'lower' WHEN bb_upper IS NOT NULL THEN 'inside' END AS s3 FROM {src}))"""


def held(src: str, key: str, entry: str, exit_: str, bps: float, name: str = "held") -> str:
    w = f"(PARTITION BY {key} ORDER BY ts)"
    return f"""{name}_p AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER {w}, 0) AS position FROM (
    SELECT *, coalesce({entry}, false) AS entry, coalesce({exit_}, false) AS exit,
           CASE WHEN coalesce({exit_}, false) THEN 0 WHEN coalesce({entry}, false) THEN 1 END AS sig FROM {src})),
  {name} AS MATERIALIZED (SELECT *, before * r AS strategy_r, position - before AS moved, abs(position - before) * {bps} / 10000.0::DOUBLE AS cost,
    before * r - abs(position - before) * {bps} / 10000.0::DOUBLE AS net_r FROM (SELECT *, lag(position) OVER {w} AS before FROM {name}_p))"""


CLASSIC = ("zscore < -2", "zscore > 0")
MIXED = ("rsi < 35 OR s2 = 'bullish'", "s3 = 'upper' OR s1 = 'bearish'")
