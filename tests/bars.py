"""Hand-made and random bars."""

import numpy as np
import pandas as pd

SCHEMA = (
    "pair string, timeframe string, date timestamp, open double, high double, low double, close double, volume double"
)


def frame(high, low, close, *, open_=None, volume=1.0, pair="X", minutes=1, start="2026-01-01"):
    n = len(close)
    return pd.DataFrame(
        {
            "pair": pair,
            "timeframe": f"{minutes}m",
            "date": pd.date_range(start, periods=n, freq=f"{minutes}min", tz="UTC"),
            "open": np.asarray(close if open_ is None else open_, dtype=float),
            "high": np.asarray(high, dtype=float),
            "low": np.asarray(low, dtype=float),
            "close": np.asarray(close, dtype=float),
            "volume": np.full(n, volume),
        }
    )


def walk(pair, n, seed, *, flat=0, gaps=0.02):
    """Random walk with missing bars and, if asked, a stretch of unchanged closes."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    close[n // 3 : n // 3 + flat] = close[n // 3]
    open_ = np.r_[100.0, close[:-1]]
    spread = np.abs(rng.normal(0, 0.01, (2, n)))
    bars = frame(
        np.maximum(open_, close) * (1 + spread[0]), np.minimum(open_, close) * (1 - spread[1]), close,
        open_=open_, pair=pair,
    )
    bars["volume"] = rng.integers(0, 20, n).astype(float)
    return bars[rng.random(n) >= gaps].reset_index(drop=True)


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf, SCHEMA)
