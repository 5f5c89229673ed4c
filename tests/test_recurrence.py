"""Exponential means: long NULL runs, late symbols, and the same values for any cut into blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.plans.ordered import blocked, core_rows
from barlens.plans.recurrence import Ema, emas, lookback_for


def series():
    rng, out = np.random.default_rng(7), {}
    x = 100 + np.cumsum(rng.normal(size=3000))
    out["full"] = x.copy()
    gap = x.copy()
    gap[900:1400] = np.nan
    gap[1500:1510] = np.nan
    gap[2999] = np.nan
    out["gap"] = gap
    late = x.copy()
    late[:1000] = np.nan
    late[1003:1700] = np.nan
    late[rng.random(3000) < 0.3] = np.nan
    out["late"] = late
    sparse = np.full(3000, np.nan)
    sparse[::397] = x[::397]
    out["sparse"] = sparse
    out["none"] = np.full(3000, np.nan)
    return out


def by_rule(x, k, seed, n, mp, gaps):
    y, out, seen, last, first = None, [], 0, None, []
    for i, v in enumerate(x):
        if v == v:
            seen += 1
            if seed == "first":
                w = (1 - k) ** (i - last) if gaps and last is not None else 1 - k
                y = v if y is None else (w * y + k * v) / (w + k)
            elif seen <= n:
                first.append(v)
                y = float(np.mean(first)) if seen == n else None
            else:
                y = (1 - k) * y + k * v
            last = i
        out.append(y if y is not None and seen >= (n if seed == "sma" else max(1, mp)) else np.nan)
    return np.array(out, dtype=float)


CASES = [("a", 1 / 3, "first", 1, 1, False), ("b", 1 / 14, "first", 1, 24, False), ("c", 1 / 3, "sma", 14, 1, False), ("d", 1 / 14, "sma", 14, 1, False),
         ("e", 2 / 25, "first", 1, 12, True), ("f", 2 / 13, "sma", 12, 1, False)]


@pytest.mark.parametrize("rows_per_block", [None, 300, 701])
def test_against_rule(spark, rows_per_block):
    data, t0 = series(), pd.Timestamp("2024-01-01")
    pdf = pd.concat([pd.DataFrame({"symbol": s, "ts": t0 + pd.to_timedelta(np.arange(len(x)), unit="h"), "x": x}) for s, x in data.items()])
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    # the memory of the fast means fits these small blocks; nothing but the later windows depends on the copied rows
    b = emas(blocked(df, 200, rows_per_block=rows_per_block), *[Ema("x", k, out, seed, n, mp, gaps) for out, k, seed, n, mp, gaps in CASES])
    got = core_rows(b).toPandas().sort_values(["symbol", "ts"])
    for s, x in data.items():
        g = got[got.symbol == s]
        assert len(g) == len(x)
        for out, *case in CASES:
            assert np.allclose(g[out].to_numpy(float), by_rule(x, *case), rtol=1e-10, atol=1e-9, equal_nan=True), (s, out)


def test_chained_and_pandas(spark):
    x = series()["gap"]
    pdf = pd.DataFrame({"symbol": "s", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(x)), unit="h"), "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    b = emas(blocked(df, 300, rows_per_block=600), Ema("x", 2 / 13, "fast"), Ema("x", 2 / 27, "slow", gaps=True))
    b = emas(b, Ema(F.col("fast") - F.col("slow"), 0.2, "signal"))
    got = core_rows(b).toPandas().sort_values("ts")
    fast, slow = pd.Series(x).ewm(span=12, adjust=False, ignore_na=True).mean(), pd.Series(x).ewm(span=26, adjust=False, ignore_na=False).mean()
    assert np.allclose(got["fast"], fast, rtol=1e-10) and np.allclose(got["slow"], slow, rtol=1e-10)
    assert np.allclose(got["signal"], (fast - slow).ewm(alpha=0.2, adjust=False).mean(), rtol=1e-9, atol=1e-10)


def test_lookback():
    assert (1 - 0.1) ** lookback_for(0.1) < 1e-17
