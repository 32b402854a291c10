import numpy as np
import pandas as pd

from barloom.operators import events as ev
from barloom.operators import indicators as ti
from tests.conftest import SCHEMA


def one(df, symbol="AAA"):
    return df.where(f"symbol = '{symbol}'").orderBy("ts").toPandas()


def close_to(got, want, tol=1e-8):
    got, want = pd.Series(got).reset_index(drop=True), pd.Series(want).reset_index(drop=True)
    assert (got.isna() == want.isna()).all()
    assert np.abs(got - want).max() < tol


def pandas_rsi(c, n=14):
    d = c.diff()
    g = d.clip(lower=0).ewm(alpha=1 / n, min_periods=n, adjust=False).mean()
    x = (-d).clip(lower=0).ewm(alpha=1 / n, min_periods=n, adjust=False).mean()
    return 100 - 100 / (1 + g / x)


def seeded(x, n, alpha):
    x = x.dropna()
    s = x.copy()
    s.iloc[: n - 1] = np.nan
    s.iloc[n - 1] = x.iloc[:n].mean()
    return s.ewm(alpha=alpha, adjust=False).mean()


def test_sma_rsi_bollinger(bars, frame):
    p = frame[frame.symbol == "AAA"].reset_index(drop=True)
    got = one(ti.bollinger(ti.rsi(ti.sma(bars, [20]))))
    close_to(got["sma_20"], p["close"].rolling(20).mean())
    close_to(got["rsi"], pandas_rsi(p["close"]))
    close_to(got["bb_upper"], p["close"].rolling(20).mean() + 2 * p["close"].rolling(20).std())


def test_macd_seeding(bars, frame):
    p = frame[frame.symbol == "BBB"].reset_index(drop=True)
    line = (seeded(p["close"], 12, 2 / 13) - seeded(p["close"], 26, 2 / 27)).reindex(p.index)
    signal = seeded(line, 9, 0.2).reindex(p.index)
    got = one(ti.macd(bars), "BBB")
    close_to(got["macd_line"], line)
    close_to(got["macd_signal"], signal)
    assert got["macd_signal"].first_valid_index() == 33


def test_atr_and_adx(bars, frame):
    p = frame[frame.symbol == "AAA"].reset_index(drop=True)
    pc = p["close"].shift()
    tr = pd.concat([p.high - p.low, (p.high - pc).abs(), (p.low - pc).abs()], axis=1).max(axis=1)
    close_to(one(ti.atr(bars))["atr"], seeded(tr, 14, 1 / 14).reindex(p.index))
    t2 = tr.copy()
    t2.iloc[0] = np.nan
    s = t2.copy()
    s.iloc[13] = t2.iloc[:14].mean()
    s.iloc[:13] = np.nan
    atr = s.ewm(alpha=1 / 14, adjust=False).mean()
    up, down = p.high.diff(), -p.low.diff()
    pdm = ((up > down) & (up > 0)) * up
    mdm = ((down > up) & (down > 0)) * down
    pdi = 100 / atr * pdm.ewm(alpha=1 / 14, adjust=False).mean()
    mdi = 100 / atr * mdm.ewm(alpha=1 / 14, adjust=False).mean()
    dx = 100 * (pdi - mdi).abs() / (pdi + mdi)
    got = one(ti.adx(bars))
    close_to(got["plus_di"], pdi)
    close_to(got["adx"], dx.ewm(alpha=1 / 14, adjust=False).mean())


def test_flat_and_rising_rsi(spark):
    rows = [("F", pd.Timestamp("2024-01-01") + pd.Timedelta(days=i), 5.0) for i in range(20)]
    rows += [("U", pd.Timestamp("2024-01-01") + pd.Timedelta(days=i), 5.0 + i) for i in range(20)]
    df = spark.createDataFrame([(a, b.to_pydatetime(), c) for a, b, c in rows], "symbol string, ts timestamp_ntz, close double")
    last = {r.symbol: r.rsi for r in ti.rsi(df).where("ts = '2024-01-20'").collect()}
    assert last == {"F": 50.0, "U": 100.0}


def test_no_look_ahead(spark, frame, bars):
    cut = frame[frame.symbol == "AAA"].iloc[:200]
    stack = lambda d: ti.adx(ti.macd(ti.rsi(ti.bollinger(d))))
    short = one(stack(spark.createDataFrame(cut, SCHEMA)))
    full = one(stack(bars)).iloc[:200]
    for c in ("rsi", "macd_signal", "bb_upper", "adx"):
        close_to(short[c], full[c], 1e-9)


def test_ichimoku_shift_and_forward(bars, frame):
    p = frame[frame.symbol == "AAA"].reset_index(drop=True)
    mid = lambda n: (p.high.rolling(n).max() + p.low.rolling(n).min()) / 2
    got = one(ti.ichimoku(bars))
    close_to(got["senkou_a"], ((mid(9) + mid(26)) / 2).shift(25))
    close_to(got["chikou"], p["close"].shift(-25))
    fwd = one(ti.ichimoku_forward(bars))
    assert len(fwd) == 26 and fwd["senkou_a"].isna().sum() == 1
    assert list(fwd["ts"]) == list(pd.bdate_range(p.ts.max() + pd.Timedelta(days=1), periods=26))


def test_crossings_alternate(bars):
    rows = ev.crossings(ti.sma(bars, [20]), "close", "sma_20", "sma").where("symbol = 'AAA'").orderBy("ts").collect()
    kinds = [r.kind for r in rows]
    assert len(kinds) > 2 and all(a != b for a, b in zip(kinds, kinds[1:]))
