import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_bars(n: int = 320, symbols=("AAA", "BBB"), seed: int = 3, tf: str = "H1") -> pd.DataFrame:
    """Random-walk bars, one hour apart."""
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        close = np.round(100 + np.cumsum(rng.normal(0, 1, n)), 2)
        open_ = np.round(np.r_[100, close[:-1]] + rng.normal(0, 0.2, n), 2)
        high = np.round(np.maximum(open_, close) + rng.exponential(0.5, n), 2)
        low = np.round(np.minimum(open_, close) - rng.exponential(0.5, n), 2)
        out.append(pd.DataFrame({"symbol": s, "timeframe": tf, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "open": open_,
                                 "high": high, "low": low, "close": close, "volume": rng.integers(1, 60, n).astype(float)}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="session")
def bars_pdf():
    return make_bars()


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    df = spark.createDataFrame(bars_pdf).cache()
    df.count()
    return df
