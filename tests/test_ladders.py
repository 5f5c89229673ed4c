"""Rules learned from losses, boards of weaknesses and the circuit, on rows that reach every branch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlens.operators import cross as X, evaluation as E, portfolio as PF, splits as SP, trades as A

FAIL = "order_id string, failure_source string, blamed_component string, classification string, severity_score int, confidence double, created_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def fails(spark, rows):
    return spark.createDataFrame([(f"{i:03d}", *r, T0 + dt.timedelta(hours=i)) for i, r in enumerate(rows)], FAIL)


def entry_penalty(rate, n, sev, conf):
    p = min(max(rate * sev / 5 * max(conf, 0.5), 0), 1) * 0.35
    if rate >= 0.55 and n >= 4 and conf >= 0.7:
        p = max(p, 0.15)
    if rate >= 0.7 and sev >= 4:
        p = max(p, 0.22)
    return min(p, 0.35)


@pytest.mark.parametrize("timing,other,sev,conf", [(1, 9, 2, 0.9), (5, 4, 1, 0.8), (8, 2, 4, 0.3), (8, 2, 5, 0.9), (8, 2, 0, None), (6, 4, 3, 0.69), (2, 0, 4, 0.6)])
def test_entry_rules(spark, timing, other, sev, conf):
    rows = [("TIMING", "Entry Logic", "LATE", sev, conf)] * timing + [("SIGNAL_QUALITY", "MACD", "WEAK", 3, 0.8)] * other
    r = A.entry_and_stop_rules(fails(spark, rows)).first()
    n = timing + other
    assert abs(r.entry_penalty - entry_penalty(timing / n, timing, sev or 1, conf or 0.0)) < 1e-12
    assert r.entry_active == (n >= 5 and timing >= 2) and r.stop_multiplier == 1.0 and not r.stop_active
    assert r.reject_active == (max(timing, other) / n >= 0.55 and n >= 5) and r.reject_if_entry_risk_gte == 0.72


def test_stop_rules_and_no_failures(spark):
    rows = [("RISK_MODEL", "X", "A", 5, 1.0), ("S", "Stop Loss", "A", 4, 0.2), (None, None, "STOP_LOSS_HIT", None, None), ("S", "MACD", "B", 2, 0.9)]
    r = A.entry_and_stop_rules(fails(spark, rows)).first()
    assert abs(r.stop_rate - 0.75) < 1e-12 and abs(r.stop_multiplier - (1 + min(0.75 * (10 / 3) / 5 * max(1.2 / 3, 0.5) * 0.8, 0.55))) < 1e-12
    assert not r.stop_active  # four losses are too few
    closed = spark.range(19)
    assert not A.entry_and_stop_rules(fails(spark, rows * 2), closed).first().stop_active
    assert A.entry_and_stop_rules(fails(spark, rows * 2), spark.range(20)).first().stop_active
    none = A.entry_and_stop_rules(fails(spark, [])).first()
    assert (none.entry_penalty, none.stop_multiplier, none.dominant_cluster, none.reject_if_entry_risk_gte) == (0.0, 1.0, 0.0, 0.75)
    assert not (none.entry_active or none.stop_active or none.reject_active)


def test_weakness_components(spark):
    rows = [("TIMING", "Entry Logic", "a", 5, 0.9), ("TIMING", "Entry Logic", "b", 1, 0.95), ("RISK_MODEL", "Entry Logic", "c", 3, 0.7), (None, "MACD", "d", None, 0.8),
            ("TIMING", None, "e", 4, 0.6), ("TIMING", "MACD", "low", 5, 0.59), ("TIMING", "MACD", "none", 5, None)]
    got = {(r.failure_source, r.blamed_component): r for r in A.weakness_components(fails(spark, rows)).collect()}
    assert set(got) == {("ALL", "Entry Logic"), ("ALL", "MACD"), ("ALL", "UNKNOWN"), ("TIMING", "Entry Logic"), ("TIMING", "UNKNOWN"), ("RISK_MODEL", "Entry Logic"), ("UNKNOWN", "MACD")}
    r = got["ALL", "Entry Logic"]
    assert (r["count"], r.weight_score, r.top_source, r.best_improvement, r.place) == (3, 9.0, "TIMING", "b", 1) and abs(r.avg_confidence - 2.55 / 3) < 1e-12
    assert got["ALL", "MACD"].avg_severity == 0 and got["ALL", "UNKNOWN"].place == 2 and got["UNKNOWN", "MACD"].top_source == "UNKNOWN"


def trades(spark, results, hour=0):
    return spark.createDataFrame([(f"{i:03d}", T0 + dt.timedelta(hours=hour + i), float(r), "eu" if i % 2 else None) for i, r in enumerate(results)],
                                 "order_id string, closed_at timestamp, realized_r double, session string")


@pytest.mark.parametrize("results,sev,status,rules", [
    ([1] * 20, [1] * 5, "CLOSED", ""), ([1] * 14 + [-1] * 6, [1] * 5, "OPEN", "max_consecutive_losses"), ([-1] * 15 + [1] * 5, [1], "OPEN", "max_failure_rate_pct"),
    ([1] * 15 + [-1] * 5, [1], "DEGRADED", "near_consecutive_losses"), ([-1] * 12 + [1] * 8, [], "DEGRADED", "near_failure_rate"),
    ([1] * 20, [1, 5, 5, 4, 3, 3], "OPEN", "max_severity_avg"), ([1] * 20, [5, 5], "DEGRADED", "near_severity"), ([1] * 20, [5, 5, 3, 3, 3, 4, 4], "CLOSED", ""),
    ([1] * 20, [5, 4, 3, 3, 4, 4, 4], "DEGRADED", "near_severity"), ([-1] * 2, [], "DEGRADED", "near_failure_rate"), ([], [], "CLOSED", "")])
def test_circuit_rules(spark, results, sev, status, rules):
    f = fails(spark, [("s", "b", "c", v, 0.9) for v in sev])
    r = A.circuit_state(trades(spark, results), f).first()
    last = sev[-5:]
    assert (r.status, r.active_rules) == (status, rules) and abs(r.avg_severity - (sum(last) / len(last) if last else 0)) < 1e-12


def test_circuit_boards(spark):
    got = {(r.board, r.label): (r.losses, r.percent) for r in A.circuit_boards(trades(spark, [-1] * 10 + [1, -1, -1], hour=5), "session", 3).collect()}
    assert got == {("session", "eu"): (1, 50.0), ("session", "unknown"): (1, 50.0), ("hour", "16:00"): (1, 50.0), ("hour", "17:00"): (1, 50.0)}


# ---- pairs of columns, selection, slices ------------------------------------------------------

def test_pair_moments_equal_corr(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    n, cols = 400, [f"c{i}" for i in range(7)]
    x = rng.normal(size=(n, 7)) @ rng.normal(size=(7, 7)) + 1e6
    x[:, 3] = 5.0
    gaps = rng.random((n, 7)) < 0.2
    df = spark.createDataFrame([tuple(None if g else float(v) for v, g in zip(a, b)) for a, b in zip(x, gaps)], ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = {(r.a, r.b): r["corr"] for r in X.correlation_pairs(df, cols, fill=None).collect()}
    assert len(got) == 21
    for (a, b), v in got.items():
        i, j = cols.index(a), cols.index(b)
        both = ~(gaps[:, i] | gaps[:, j])
        if 3 in (i, j):
            assert v is None
        else:
            assert abs(v - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9


def test_many_columns_plan_quickly(spark):
    import time
    t = time.time()
    df = spark.range(50).select(*[F.xxhash64("id", F.lit(i)).cast("double").alias(f"c{i}") for i in range(520)])  # more than one band
    assert X.correlation_pairs(df, df.columns).count() == 520 * 519 // 2
    assert time.time() - t < 90


def test_greedy_selection_in_rounds(spark):
    ic = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("c", 0.3), ("d", 0.3), ("e", 0.001)], "feature string, abs_ic double")
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.9), ("a", "c", 0.1), ("c", "d", -0.8), ("a", "d", None)], "a string, b string, corr double")
    assert E.greedy_select(ic, pairs) == ["a", "c"] and E.greedy_select(ic, pairs, corr_threshold=0.95) == ["a", "b", "c", "d"] and E.greedy_select(ic, pairs, 1) == ["a"]


def test_slices_do_not_change_splits_and_curves(spark):
    df = spark.range(500).select((F.pmod(F.xxhash64("id"), F.lit(97)) / 1000.0 - 0.05).alias("ret"), F.timestamp_seconds("id").alias("ts"), "id")
    a, b = (sorted((r.id, r.split) for r in SP.temporal_split(df, ["ts", "id"], rows_per_slice=n).collect()) for n in (None, 37))
    assert a == b and [s for _, s in a].count("discovery") == 300
    x, y = (PF.return_metrics(df, [], ["ts"], "ret", 252, rows_per_slice=n).first() for n in (None, 37))
    assert all(abs(p - q) < 1e-9 for p, q in zip(x, y))
