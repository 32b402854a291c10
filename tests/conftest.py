import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="6g")


def walk(n=300, seed=7, symbol="AAA", start="2023-01-02"):
    """Random-walk bars on business days."""
    rng = np.random.default_rng(seed)
    close = 100 * np.cumprod(1 + rng.normal(0.0004, 0.015, n))
    opened = np.concatenate([[100.0], close[:-1]])
    high = np.maximum(opened, close) * (1 + rng.uniform(0, 0.01, n))
    low = np.minimum(opened, close) * (1 - rng.uniform(0, 0.01, n))
    return pd.DataFrame({
        "symbol": symbol, "ts": pd.bdate_range(start, periods=n), "open": opened, "high": high, "low": low, "close": close,
        "volume": rng.integers(1_000_000, 5_000_000, n).astype(float)})


SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="session")
def frame():
    return pd.concat([walk(), walk(seed=11, symbol="BBB", n=260)], ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, frame):
    return spark.createDataFrame(frame, SCHEMA).repartition(4).cache()


def closes(spark, values, symbol="X", start="2024-01-01"):
    ts = pd.bdate_range(start, periods=len(values))
    rows = [(symbol, t.to_pydatetime(), float(v)) for t, v in zip(ts, values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")


def collected(df, *cols):
    return df.orderBy("symbol", "ts").toPandas()[list(cols)]
