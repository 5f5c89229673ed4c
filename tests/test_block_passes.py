"""Passes over blocks: moving order statistics, first touches and extremes, windows through any function."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.functions import trading as P
from barlens.operators import labels as L
from barlens.plans.first_touch import Extremes
from barlens.plans.order_stats import Moving, Ranks, moving, windows_through
from barlens.plans.ordered import blocked, core_rows


def series(n, seed=1, symbols=2):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(symbols):
        close = 100 + np.cumsum(rng.normal(size=n)).round(1)
        out.append(pd.DataFrame({"symbol": f"S{s}", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "close": close,
                                 "high": close + rng.integers(0, 4, n), "low": close - rng.integers(0, 4, n)}))
    return pd.concat(out)


def test_ranks_of_stretches():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 300):
        x = rng.integers(0, max(n // 3, 1) + 1, n).astype(float)
        r = Ranks(x)
        lo = rng.integers(0, n + 1, 200)
        hi = np.minimum(lo + rng.integers(0, n + 1, 200), n)
        place, rank = rng.integers(-1, n + 1, 200), rng.integers(0, len(r.values) + 1, 200)
        limit = np.append(r.values, np.inf)[rank]
        assert (r.below(lo, hi, rank) == [(x[a:b] < v).sum() for a, b, v in zip(lo, hi, limit)]).all()
        want = [np.sort(x[a:b])[k] if 0 <= k < b - a else np.nan for a, b, k in zip(lo, hi, place)]
        assert np.array_equal(r.at(lo, hi, place), want, equal_nan=True)


@pytest.mark.parametrize("n,rows_per_block", [(3, 10), (50, 60), (200, None)])
def test_moving_statistics_equal_pandas(spark, n, rows_per_block):
    pdf = series(700).reset_index(drop=True)
    pdf.loc[5::11, "close"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    stats = [Moving("med", "close", "quantile", n), Moving("q9", "close", "quantile", n, 0.9, full=False, mp=2), Moving("third", "close", "place", n, 2, full=False),
             Moving("rank", "close", "rank", n, full=False), Moving("less", "low", "below", n, back=1)]
    got = core_rows(moving(blocked(df, n + 1, rows_per_block=rows_per_block), *stats)).toPandas().sort_values(["symbol", "ts"])
    for s, g in pdf.groupby("symbol"):
        mine = got[got.symbol == s]
        roll = g.close.rolling(n, min_periods=1)
        full = np.arange(len(g)) >= n - 1
        assert np.allclose(mine.med, roll.median().where(full), equal_nan=True)
        assert np.allclose(mine.q9, g.close.rolling(n, min_periods=2).quantile(0.9), equal_nan=True)
        assert np.allclose(mine["rank"], roll.rank(pct=True).where(g.close.notna()), equal_nan=True)
        third = [np.sort(w)[2] if len(w := g.close.iloc[max(0, i - n + 1):i + 1].dropna()) > 2 else np.nan for i in range(len(g))]
        assert np.allclose(mine.third, third, equal_nan=True)
        less = [(g.low.iloc[i - n:i] < g.low.iloc[i]).mean() if i >= n else np.nan for i in range(len(g))]
        assert np.allclose(mine.less, less, equal_nan=True)


def test_any_function_of_a_window(spark):
    pdf = series(300)
    df = blocked(spark.createDataFrame(pdf), 25, rows_per_block=40)
    got = core_rows(windows_through(df, "spread", "close", 25, lambda v: np.ptp(v, axis=1))).toPandas().sort_values(["symbol", "ts"])
    for s, g in pdf.groupby("symbol"):
        want = g.close.rolling(25).max() - g.close.rolling(25).min()
        assert np.allclose(got[got.symbol == s].spread, want, equal_nan=True)


def test_extremes_and_first_places():
    rng = np.random.default_rng(4)
    for largest in (True, False):
        x = rng.integers(0, 30, 200).astype(float)
        x[::13] = np.nan
        for most in (1, 2, 3, 24, 200, 900):
            t = Extremes(x, largest, most)
            start = rng.integers(0, 200, 300)
            stop = np.minimum(start + rng.integers(0, min(most, 200) + 1, 300), 200)
            level = rng.integers(-2, 33, 300).astype(float)
            level[::7] = np.nan
            hit = [next((j for j in range(a, b) if (x[j] >= v if largest else x[j] <= v)), b) for a, b, v in zip(start, stop, level)]
            assert (t.first(start, stop, level) == hit).all()
            with np.errstate(all="ignore"):
                pick = np.fmax if largest else np.fmin
                want = [pick.reduce(x[a:b]) if b > a else np.nan for a, b in zip(start, stop)]
            assert np.array_equal(t.of(start, stop), want, equal_nan=True)


@pytest.mark.parametrize("h,mode", [(1, "adverse"), (12, "adverse"), (24, "reference"), (100, "adverse")])
def test_exits_equal_those_of_paths(spark, h, mode):
    """The sparse tables give what the array of the next bars gives, row by row, liquidation included."""
    df = blocked(spark.createDataFrame(series(260, seed=h)), 2, h, rows_per_block=max(40, h))
    df = df.withColumns({**P.stop_target_levels("close", F.lit(2.0), F.lit(1.5), F.lit(2.0)), "risk": F.lit(3.0), "liq": F.col("close") - 2.5, "liq2": F.col("close") + 2.5})
    new = L.barrier_exits(df, h, [L.Barrier("a", "LONG", "long_stop", "long_target"), L.Barrier("b", "SHORT", "short_stop", "short_target"),
                                  L.Barrier("c", "LONG", "long_stop", "long_target", "liq"), L.Barrier("d", "SHORT", "short_stop", "short_target", "liq2")], "close", "risk", mode)
    old = L.with_path(df, h).filter("core")
    for out, side, liq in (("a", "LONG", None), ("b", "SHORT", None), ("c", "LONG", "liq"), ("d", "SHORT", "liq2")):
        old = L.barrier_exit(old, out, side, "close", f"{side.lower()}_stop", f"{side.lower()}_target", "risk", liquidation=liq, mae_mode=mode)
    cols = ["symbol", "ts", "a", "b", "c", "d"]
    got, want = (sorted((r.asDict(recursive=True) for r in x.select(cols).collect()), key=lambda r: (r["symbol"], r["ts"])) for x in (new, old))
    assert len(got) == len(want) == 520
    for g, w in zip(got, want):
        for k in "abcd":
            for name, v in w[k].items():
                assert g[k][name] == v or (v is not None and abs(g[k][name] - v) < 1e-9), (k, name, g[k], w[k])


def test_a_long_horizon_costs_little_more(spark):
    """Steps per row grow with the logarithm of the horizon: the tables of 2,000 bars have 11 levels, those of 24 have 5."""
    x = np.random.default_rng(1).normal(size=50_000)
    assert [len(Extremes(x, True, h).levels) for h in (24, 2000)] == [5, 11]
