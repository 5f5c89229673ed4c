"""Ordered layouts against pandas, with cuts small enough to matter."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.operators import joins as J, mining as MI, portfolio as PF, regime as RG
from barlens.operators.signals import block_bootstrap_ci
from barlens.plans.draws import permuted, times_drawn
from barlens.plans.hops import rounds_for, thinned
from barlens.plans.intervals import points_in_ranges
from barlens.plans.ordered import blocked, core_rows, frame, running, with_slices
from barlens.plans.quantiles import exact_quantiles
from barlens.plans.recurrence import ema, lookback_for
from barlens.plans.vertical import extended, vertical
from barlens.sources import tables as S


def hot_ticks(spark, sf):
    """A third of the ticks at one instant."""
    t = S.ticks(spark, sf)
    return t.withColumn("ts", F.when(F.col("event_id") % 3 == 0, F.lit("2024-01-10").cast("timestamp")).otherwise(F.col("ts")))


def test_slices_split_a_hot_instant(spark, sf):
    s = with_slices(hot_ticks(spark, sf), ["side"], ["ts", "event_id"], 20).groupBy("side", "_slice").count()
    assert s.agg(F.max("count")).first()[0] <= 40


@pytest.mark.parametrize("limit", [None, 20])
def test_running_matches_pandas(spark, sf, limit):
    t = hot_ticks(spark, sf)
    r = running(t, ["side"], ["ts", "event_id"], {
        "cs": ("sum", F.col("price")), "mx": ("max", F.col("price")), "n": ("count", F.lit(1)),
        "la": ("last", F.when(F.col("k") > 50, F.col("price")))}, rows_per_slice=limit).toPandas()
    r = r.sort_values(["side", "ts", "event_id"]).reset_index(drop=True)
    g = r.groupby("side")
    assert np.allclose(g.price.cumsum(), r.cs) and (g.price.cummax() == r.mx).all() and (g.cumcount() + 1 == r.n).all()
    assert (r.price.where(r.k > 50).groupby(r.side).ffill().fillna(-1) == r.la.fillna(-1)).all()


@pytest.mark.parametrize("limit", [None, 20])
def test_exact_quantiles(spark, sf, limit):
    t = hot_ticks(spark, sf)
    q = exact_quantiles(t, ["side"], "price", {"a": 0.1, "m": 0.5, "z": 0.99}, rows_per_slice=limit).toPandas().set_index("side")
    want = t.toPandas().groupby("side").price.quantile([0.1, 0.5, 0.99]).unstack()
    assert np.allclose(q.loc[want.index, ["a", "m", "z"]].to_numpy(), want.to_numpy())


def test_blocks_see_full_frames(bars):
    x = core_rows(blocked(bars, 20, 3, rows_per_block=24).withColumns({
        "m": F.avg("close").over(frame(20)), "ld": F.lead("close", 3).over(frame())}), drop=()).toPandas()
    x = x.sort_values(["symbol", "ts"]).reset_index(drop=True)
    g = x.groupby("symbol").close
    assert len(x) == bars.count()
    assert np.allclose(g.rolling(20, min_periods=1).mean().to_numpy(), x.m)
    assert (g.shift(-3).fillna(-1) == x.ld.fillna(-1)).all()


@pytest.mark.parametrize("k", [2 / 3, 0.2, 1 / 14])
def test_ema_over_many_blocks(spark, k):
    """A long series, so that the truncated past is really truncated."""
    n = 3000
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "close": rng.normal(100, 10, n)})
    pdf.loc[5::17, "close"] = None
    df = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    look = lookback_for(k)
    x = ema(blocked(df, 2 * look, rows_per_block=max(600, 2 * look)), "close", k, "e", gaps=True)
    got = core_rows(x).toPandas().sort_values("ts").e.to_numpy()
    want = pdf.close.ewm(alpha=k, adjust=False, ignore_na=False).mean().to_numpy()
    assert np.allclose(got, want, rtol=1e-9)


def test_range_join_equals_filter(spark, sf):
    t = S.ticks(spark, sf)
    r = t.filter("event_id % 5 = 0").select("symbol", "event_id", "ts", F.timestamp_add("HOUR", F.col("k"), F.col("ts")).alias("end"))
    p = t.select("symbol", F.col("event_id").alias("pid"), F.col("ts").alias("pt"))
    want = r.join(p, "symbol").filter("pt > ts and pt <= end").count()
    for most in (1000, 7, 1):
        got = points_in_ranges(r, p, ["symbol"], "ts", "end", "pt", bucket_seconds=7200, how="inner", most=most)
        assert got.count() == want
    left = points_in_ranges(r, p, ["symbol"], "ts", "end", "pt", bucket_seconds=7200)
    assert left.select("event_id").distinct().count() == r.count()


@pytest.mark.parametrize("closed", ["right", "left", "both"])
def test_range_join_cuts_full_buckets_only(spark, closed):
    """Half the points are one symbol's, a tenth of them at one instant; repeated ranges are kept apart."""
    rng = np.random.default_rng(9)
    at = np.concatenate([rng.integers(0, 5000, 900), np.full(100, 2500), rng.integers(0, 50_000, 1000)]).tolist()
    pts = [("hot" if i < 1000 else f"s{i % 50}", int(t), i) for i, t in enumerate(at)]
    rgs = [("hot", int(a), int(a + w)) for a, w in zip(rng.integers(-100, 5100, 60), rng.integers(0, 900, 60))] + [("hot", 2000, 3000)] * 2 + [("s1", 10, 40_000), ("none", 1, 2), ("hot", 9, 3)]
    p = spark.createDataFrame(pts, "symbol string, t long, pid long").select("symbol", F.timestamp_seconds("t").alias("pt"), "pid")
    r = spark.createDataFrame(rgs, "symbol string, a long, b long").select("symbol", F.timestamp_seconds("a").alias("ts"), F.timestamp_seconds("b").alias("end"))
    inside = {"right": lambda a, t, b: a < t <= b, "left": lambda a, t, b: a <= t < b, "both": lambda a, t, b: a <= t <= b}[closed]
    pairs = [(s, a, b, i) for s, a, b in rgs for q, t, i in pts if q == s and inside(a, t, b)]
    matched = {(s, a, b) for s, a, b, _ in pairs}
    want = sorted(pairs + [(s, a, b, -1) for s, a, b in rgs if (s, a, b) not in matched])
    for most in (50, 100_000):
        got = points_in_ranges(r, p, ["symbol"], "ts", "end", "pt", bucket_seconds=3600, closed=closed, most=most)
        assert sorted((x.symbol, int(x.ts.timestamp()), int(x.end.timestamp()), -1 if x.pid is None else x.pid) for x in got.collect()) == want


def test_drawdown_is_independent_of_slices(spark, sf):
    t = S.trades(spark, sf)
    a = PF.max_drawdown(t, ["mode"], ["closed_at", "order_id"], "realized_r").toPandas().sort_values("mode")
    b = PF.max_drawdown(t, ["mode"], ["closed_at", "order_id"], "realized_r", rows_per_slice=37).toPandas().sort_values("mode")
    c = PF.equity_curve(t, ["mode"], ["closed_at", "order_id"], "realized_r", rows_per_slice=37).groupBy("mode").agg(F.max("drawdown").alias("d"))
    assert np.allclose(a.max_drawdown, b.max_drawdown)
    assert np.allclose(a.max_drawdown, c.toPandas().sort_values("mode").d)


def test_stateful_passes_do_not_depend_on_chunks(bars):
    for fn, col in ((lambda n: RG.cusum(bars, 1.5, rows_per_chunk=n), "cusum_positive"),
                    (lambda n: RG.vol_state(bars, rows_per_chunk=n), "hmm_vol_probability")):
        a, b = (fn(n).toPandas().sort_values(["symbol", "ts"])[col].fillna(-1).to_numpy() for n in (10_000, 16))
        assert np.allclose(a, b)


def test_thinning_by_chunks_equals_greedy(bars):
    sig = bars.filter("close > open").select("symbol", "ts")
    got = {(r.symbol, r.ts) for r in J.thin_by_min_gap(sig, ["symbol"], 86400.0, rows_per_chunk=5).collect()}
    want = set()
    for sym, g in sig.toPandas().sort_values("ts").groupby("symbol"):
        last = None
        for ts in g.ts:
            if last is None or (ts - last).total_seconds() >= 86400:
                want.add((sym, ts.to_pydatetime()))
                last = ts
    assert got == want


def test_slices_of_texts_with_a_common_beginning(spark):
    t = spark.range(10_000).select(F.lit("k").alias("key"), F.format_string("order-%016d", "id").alias("order_id"))
    s = with_slices(t, ["key"], ["order_id"], 100).groupBy("_slice").agg(F.count(F.lit(1)).alias("n"), F.min("order_id").alias("a"), F.max("order_id").alias("b"))
    rows = s.orderBy("a").collect()
    assert len(rows) > 80 and max(r.n for r in rows) < 300
    assert all(x.b < y.a and x._slice < y._slice for x, y in zip(rows, rows[1:]))


def test_sums_of_chunks_give_the_level_after_them():
    rng = np.random.default_rng(8)
    for seed in range(60):
        steps = rng.normal(0.05 * (seed % 3 - 1), 1.0, int(rng.integers(1, 300))).round(2)
        limit = float(rng.choice([0.5, 2.0, 6.0, 40.0]))
        summed = RG.sum_map(steps, limit)
        for level in [0.0, limit, *rng.uniform(0, limit, 20).round(2)]:
            want = RG.restarting_sum(steps, float(level), limit)[2]
            got, rest = RG.sum_through(summed + [1.0], float(level), limit)
            assert rest == [1.0] and abs(got - want) < 1e-9, (seed, limit, level)


@pytest.mark.parametrize("rows,gap,chunk", [(640, 7.0, 20), (640, 7.5, 10), (300, 50.0, 8), (200, 1.0, 16)])
def test_thinning_takes_log_rounds_on_a_grid(spark, rows, gap, chunk):
    """A regular grid never merges chains; one symbol, many chunks."""
    df = spark.createDataFrame([("A", float(i)) for i in range(rows)] + [("B", 5.0), ("B", 5.0), ("B", 11.9), ("B", 12.0)], "symbol string, at double")
    got, rounds = thinned(df, ["symbol"], "at", gap, rows_per_chunk=chunk)
    want, last = [], None
    for i in range(rows):
        if last is None or i >= last + gap:
            want.append(float(i))
            last = i
    assert sorted(r["at"] for r in got.collect() if r["symbol"] == "A") == want
    assert 0 < rounds <= rounds_for(-(-rows // chunk)) and rounds <= np.log2(rows / chunk) + 1


def test_thinning_of_random_times(spark):
    rng = np.random.default_rng(5)
    times = np.sort(rng.integers(0, 4000, 900)).tolist()
    df = spark.createDataFrame([(k, float(t)) for k in ("x", "y") for t in times], "k string, at double")
    for gap in (3.0, 40.0):
        got = thinned(df, ["k"], "at", gap, rows_per_chunk=30)[0].collect()
        want, last = [], None
        for t in times:
            if last is None or t >= last + gap:
                want.append(float(t))
                last = t
        assert sorted(r["at"] for r in got if r["k"] == "x") == want == sorted(r["at"] for r in got if r["k"] == "y")


def test_permutations_and_draws():
    for size in (1, 2, 5, 16, 17, 1000):
        for which in range(3):
            assert sorted(permuted(np.arange(size), size, 42, which)) == list(range(size))
    assert (permuted(np.arange(1000), 1000, 42, 0) != permuted(np.arange(1000), 1000, 42, 1)).mean() > 0.9
    whole = dict(times_drawn(np.arange(37), 37, 400, 7))
    table = np.stack([whole[i] for i in range(37)])
    assert (table.sum(axis=0) == 37).all()  # as many draws as places in every resample
    assert abs(table.mean() - 1) < 1e-12 and abs(table.var() - (1 - 1 / 37)) < 0.05  # binomial counts
    some = dict(times_drawn(np.array([3, 20, 36]), 37, 400, 7))
    assert all((some[i] == table[p]).all() for i, p in enumerate([3, 20, 36]))  # a task needs only its own places


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(2001)) / 1000.0 - 1.0).alias("r"))
    a = block_bootstrap_ci(df, ["id"], "r", 50, 300).first()
    b = block_bootstrap_ci(df.repartition(7), ["id"], "r", 50, 300, rows_per_slice=200).first()
    assert a.n_blocks == b.n_blocks == 60 and abs(a.ci_lower - b.ci_lower) < 1e-12 and abs(a.ci_upper - b.ci_upper) < 1e-12
    sd = df.agg(F.stddev("r")).first()[0] / 3000 ** 0.5
    assert 2.5 < (a.ci_upper - a.ci_lower) / sd < 5.5 and a.ci_lower < a.mean_r < a.ci_upper


def test_sets_per_condition(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.normal()) if rng.random() > 0.1 else None, sorted({f"c{int(v)}" for v in rng.geometric(0.15, int(rng.integers(0, 6)))})) for _ in range(700)]
    df = spark.createDataFrame(rows, "y double, conds array<string>").repartition(3)
    rules = [["c1"], ["c1", "c3"], ["c2", "c4", "c5"], ["nowhere"]]
    want = {}
    for i, rule in enumerate(rules):
        for y, cs in rows:
            if set(rule) <= set(cs):
                for c in set(cs) - set(rule):
                    n, k, s = want.get((i, c), (0, 0, 0.0))
                    want[i, c] = (n + 1, k + (y is not None), s + (y or 0.0))
    for size in (64, 65536):
        got = {(r.rule, r.condition): (r.n, r.k, r.s) for r in extended(vertical(df, "y", "conds", size), rules).collect()}
        assert got.keys() == want.keys() and all(got[q][:2] == want[q][:2] and abs(got[q][2] - want[q][2]) < 1e-9 for q in want)


def test_beam_over_many_conditions(spark):
    """20,000 conditions: none of them comes to the driver or into the plan; the planted rule is found."""
    df = spark.range(20_000).select(F.when((F.col("id") % 50 == 7) & (F.col("id") % 3 == 1), 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("y"),
                                    F.array_sort(F.array(F.concat(F.lit("a"), (F.col("id") % 50).cast("string")), F.concat(F.lit("b"), (F.col("id") % 3).cast("string")),
                                                         F.concat(F.lit("rare"), F.col("id").cast("string")))).alias("conditions"))
    top = MI.beam_search(df, "y", beam=8, depth=2, min_support=0.002, rows_per_slice=4096).orderBy(F.desc("score")).first()
    assert list(top["rule"]) == ["a7", "b1"] and top["score"] == 5.0 and top["support"] == 134
