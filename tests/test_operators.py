"""Golden candles, causality, negative controls and edge inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.functions import trading as P
from barlens.operators import cross as X, evaluation as E, features as ft, flow as fl, indicators as IN, joins as J, labels as L, quality as Q
from barlens.operators import mining as M, modeleval as C, splits as SP, ticks as TK
from barlens.plans.ordered import blocked
from barlens.sources import tables as S


def candle(spark, path, entry=3000.0, atr=50.0, side="LONG", stop=1.5, target=1.5, **kw):
    row = [(entry, atr, *([float(p[i]) for p in path] for i in range(3)))]
    df = spark.createDataFrame(row, "entry double, atr double, _hi array<double>, _lo array<double>, _cl array<double>")
    df = df.withColumns({**P.stop_target_levels("entry", "atr", F.lit(stop), F.lit(target)), "risk": P.entry_risk("atr", F.lit(stop))})
    s = side.lower()
    return L.barrier_exit(df, "x", side, "entry", f"{s}_stop", f"{s}_target", "risk", **kw).select("x.*").first()


def test_golden_target_and_stop(spark):
    up = candle(spark, [(3030, 2990, 3020), (3060, 3010, 3050), (3100, 3040, 3090)])
    assert (up.exit_reason, up.exit_bar_index) == ("TARGET_HIT", 2) and abs(up.gross_r - 1.0) < 1e-12
    assert up.mfe == 60 and up.mae == -10 and up.time_to_mfe == 1  # the exit bar is not counted
    dn = candle(spark, [(3010, 2960, 2970), (2980, 2900, 2910)])
    assert (dn.exit_reason, dn.gross_r) == ("STOP_HIT", -1.0)


def test_golden_edges(spark):
    both = candle(spark, [(3200, 2800, 3000)])
    assert both.exit_reason == "STOP_HIT" and both.same_bar  # the stop wins
    touch = candle(spark, [(3075, 3000, 3010)])
    assert touch.exit_reason == "TARGET_HIT"
    none = candle(spark, [])
    assert none.exit_reason == "TIME_EXIT" and none.exit_price == 3000 and none.gross_r == 0
    late = candle(spark, [(3010, 2990, 3005), (3020, 2995, 3015)])
    assert late.exit_reason == "TIME_EXIT" and late.exit_price == 3015 and late.mfe == 20
    flat = candle(spark, [(3010, 2990, 3005)], atr=0.0)
    assert flat.gross_r == 0.0
    a = candle(spark, [(3040, 2990, 3000)], side="SHORT")
    b = candle(spark, [(3040, 2990, 3000)], side="SHORT", mae_mode="reference")
    assert a.mae == -40 and b.mae == 0


def test_liquidation_beats_stop(spark):
    df = candle(spark, [(3010, 2900, 2950)], liquidation=None)
    assert df.exit_reason == "STOP_HIT"


@pytest.mark.parametrize("group,cols,look", [
    (ft.returns_group, ["return_zscore_N"], 21), (ft.atr_wilder, ["atr_wilder"], 700), (ft.macd, ["macd_histogram"], 900),
    (ft.scalp_momentum_group, ["mom_quality", "mom_divergence"], 13), (ft.extended_alpha_group, ["range_percentile"], 193),
    (lambda x: fl.orderbook_group(ft.base(x)), ["vpin_N", "serial_correlation_N"], 52), (ft.taker_flow_group, ["cvd_divergence"], 72)])
def test_no_revision(bars, group, cols, look):
    """A feature at t does not change when later bars arrive."""
    cut = F.lit("2024-01-20").cast("timestamp")
    full = ft.on_bars(bars, look, group).filter(F.col("ts") <= cut)
    part = ft.on_bars(bars.filter(F.col("ts") <= cut), look, group)
    a, b = (x.select("symbol", "ts", *cols).toPandas().sort_values(["symbol", "ts"]) for x in (full, part))
    assert len(a) == len(b) and len(a) > 0
    for c in cols:
        assert np.allclose(a[c].astype(float).fillna(-9), b[c].astype(float).fillna(-9))


def test_windows_do_not_depend_on_blocks(bars):
    cols = ["rsi", "cci", "adx", "vwap", "obv"]
    a = IN.runtime_indicators(bars).toPandas().sort_values(["symbol", "ts"])
    b = ft.on_bars(bars, 40, ft.volume_cumulative, rows_per_block=48).toPandas().sort_values(["symbol", "ts"])
    c = ft.on_bars(bars, 40, ft.volume_cumulative).toPandas().sort_values(["symbol", "ts"])
    assert np.allclose(b.obv_N, c.obv_N) and np.allclose(b.vwap_cum, c.vwap_cum)
    assert np.allclose(a.vwap, c.vwap_cum) and a[cols].notna().all().all()


def test_edge_inputs(spark):
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    t = pd.Timestamp("2024-01-01")
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([("A", t.to_pydatetime(), 1.0, 1.0, 1.0, 1.0, 0.0)], schema)
    rows = [("A", (t + pd.Timedelta(hours=i)).to_pydatetime(), None if i == 3 else 5.0, 5.0, 5.0, None if i == 3 else 5.0, 0.0) for i in range(30)]
    const = spark.createDataFrame(rows, schema)
    for df, n in ((none, 0), (one, 1), (const, 30)):
        assert ft.on_bars(df, 60, ft.returns_group, ft.atr_group, ft.bollinger, ft.candle_group, lambda x: fl.orderbook_group(ft.base(x))).count() == n
        assert ft.on_bars(df, 700, ft.rsi, ft.macd).count() == n
    z = ft.on_bars(const, 21, ft.returns_group).filter("return_zscore_N is not null").select("return_zscore_N").distinct().collect()
    assert [r[0] for r in z] == [0.0]


def test_asof_takes_no_future_and_respects_tolerance(spark, sf):
    t, f = S.ticks(spark, sf), S.funding(spark, sf)
    a = J.asof_join(t, f, ["symbol"], {"rate": "rate"}, order=["event_id"], tolerance="6 hours", rows_per_slice=15).toPandas().sort_values("event_id")
    b = J.asof_join(t, f, ["symbol"], {"rate": "rate"}, order=["event_id"], tolerance="6 hours").toPandas().sort_values("event_id")
    assert (a.rate.fillna(9).to_numpy() == b.rate.fillna(9).to_numpy()).all()
    hit = a[a.rate.notna()]
    assert (hit.overlay_ts <= hit.ts).all() and (hit.ts - hit.overlay_ts <= pd.Timedelta(hours=6)).all()
    moved = J.asof_join(t, f.withColumn("ts", F.timestamp_add("HOUR", F.lit(8), F.col("ts"))), ["symbol"], {"rate": "rate"}, order=["event_id"])
    assert not np.array_equal(moved.toPandas().sort_values("event_id").rate.fillna(9), b.rate.fillna(9))  # negative control


def test_walk_forward_has_no_overlap(bars):
    r = SP.walk_forward_roles(bars, 60, 50, 10).toPandas()
    assert r.groupby(["fold", "ti"]).role.nunique().max() == 1
    for _, g in r.groupby("fold"):
        assert g[g.role == "train"].ti.max() + 10 < g[g.role == "val"].ti.min()
        assert g[g.role == "val"].ti.max() + 10 < g[g.role == "oos"].ti.min()


def test_duplicates_and_hot_copies(spark):
    rows = [("A", "2024-01-01 00:00:00", i) for i in range(50)] + [("B", "2024-01-01 00:00:00", 1)]
    df = spark.createDataFrame(rows, "symbol string, t string, id int").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    assert Q.detect_duplicates(df, ["symbol", "ts"], ["id"]).count() == 49
    assert {(r.symbol, r.id) for r in Q.dedup_last(df, ["symbol", "ts"], ["id"]).collect()} == {("A", 49), ("B", 1)}


def test_tick_features_do_not_depend_on_slices(spark, sf):
    t = S.ticks(spark, sf)
    a, b = (TK.tick_features(t, "4 hours", n).toPandas().sort_values(["symbol", "ts"]) for n in (None, 3))
    assert np.allclose(a.ret_std.fillna(-1), b.ret_std.fillna(-1)) and np.allclose(a.large_share, b.large_share)


def test_rank_matrix_equals_window(bars):
    a = X.cs_rank_matrix(bars, ["close"]).toPandas().sort_values(["symbol", "ts"]).close.to_numpy()
    b = bars.withColumn("r", X.cs_rank_center("close")).toPandas().sort_values(["symbol", "ts"]).r.to_numpy()
    assert np.allclose(a, b)


def test_perfect_score_has_ic_one(bars):
    b = E.forward_returns(bars, [1])
    s = b.select("ts", "symbol", F.lit("f").alias("factor"), F.col("fwd_1").alias("score"), "fwd_1")
    ic = E.rank_ic(s, "fwd_1").filter("rank_ic is not null")
    assert ic.filter("abs(rank_ic - 1) > 1e-9").count() == 0 and ic.count() > 0


def test_beam_search_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"order_id": range(400), "a": rng.integers(0, 3, 400), "b": rng.integers(0, 3, 400), "y": rng.normal(0, 1, 400)})
    pdf["y"] += np.where((pdf.a == 1) & (pdf.b == 2), 2.0, 0.0)
    df = spark.createDataFrame(pdf).withColumn("conditions", F.array_sort(F.array(F.concat(F.lit("a"), "a"), F.concat(F.lit("b"), "b"))))
    top = M.beam_search(df, "y", beam=6, depth=2).orderBy(F.desc("score")).first()
    assert top.rule == ["a1", "b2"]
    sel = pdf[(pdf.a == 1) & (pdf.b == 2)]
    assert top.support == len(sel) and abs(top.score - sel.y.mean()) < 1e-9
    p = M.level2_scan(df, "y", 0.0).toPandas()
    assert len(p) == 9 and p.support.sum() == 400


def test_families_are_connected_components(spark):
    rules = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0), ("d", 0.5)], "rule_id string, mean_r double")
    sim = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "d", 0.1)], "a string, b string, similarity double")
    got = {r.rule_id: (r.family, r.is_representative) for r in M.dedupe_rules(rules, sim).collect()}
    assert got == {"a": ("a", False), "b": ("a", True), "c": ("a", False), "d": ("d", True)}


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(0, 1, 300), 2), np.round(rng.normal(0.3, 1, 200), 2)
    a, b = (spark.createDataFrame(pd.DataFrame({"v": z})) for z in (x, y))
    grid = np.unique(np.r_[x, y])
    want = max(abs((x <= g).mean() - (y <= g).mean()) for g in grid)
    for n in (None, 25):
        assert abs(C.ks_two_sample(a, b, "v", n).first().ks - want) < 1e-12


def test_specialists_recover_coefficients(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"symbol": "A", "u": rng.normal(0, 1, 500), "v": rng.normal(0, 1, 500)})
    pdf["y"] = 1.0 + 2.0 * pdf.u - 0.5 * pdf.v
    r = C.symbol_specialists(spark.createDataFrame(pdf), ["u", "v"], "y", ridge=1e-9).first()
    assert np.allclose(r.coef, [1.0, 2.0, -0.5], atol=1e-6)


def test_feature_groups_add_no_shuffle(bars):
    """More groups share the placement by (symbol, block)."""
    def shuffles(*groups):
        return ft.on_bars(bars, 60, *groups)._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert shuffles(ft.returns_group) == shuffles(ft.returns_group, ft.atr_group, ft.bollinger, ft.range_breakout, ft.candle_group)


def test_registered_factor_is_evaluated(spark, bars):
    from barlens.operators import evaluation as E, factors as FA
    assert {"ts", "symbol", "close"} <= set(bars.columns)
    FA.register_input("range_share", ("rng",), lambda: F.col("rng") / F.col("close"))
    FA.register_factor("quiet_bars", "long", ("range_share", "ret_4"), lambda: F.col("ret_4") - F.col("range_share"), kind="rank")
    try:
        got = FA.compute_factors(bars, ["quiet_bars", "momentum_20"], "S01")
        assert {"quiet_bars", "momentum_20"} <= set(got.columns)
        w = E.forward_returns(got, [1], keep=["quiet_bars"])
        r = E.evaluate(E.long_scores(w, ["quiet_bars"], ["fwd_1"]), [1], {"quiet_bars": "long"}, 20).collect()
        assert [x["factor"] for x in r] == ["quiet_bars"]
        with pytest.raises(ValueError):
            FA.register_factor("quiet_bars", "long", (), lambda: F.lit(1.0))
        with pytest.raises(ValueError):
            FA.register_factor("other", "long", ("no_such_input",), lambda: F.lit(1.0))
        # only what is asked for is built
        assert FA.needed(["range_share", "ret_4"]) == ["rng", "range_share", "ret_4"]
    finally:
        FA.FACTORS.pop("quiet_bars", None)
        FA.INPUTS.pop("range_share", None)
