"""The driver contract, and a sample of queries against DuckDB."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SAMPLE = ["TS4_ffill_resample", "DQ3_quality_report", "P27_buckets", "W18_macd", "W28_consecutive", "X8_residual_return", "F11_trend_pullback_ema",
          "E2_rank_ic", "J1_asof_join", "J4_event_window_sum", "L2_barrier_label", "L12_purged_expanding", "A5_group_metrics", "A20_profitability",
          "M1_fit_deciles", "C11_ks_two_sample", "K2_top_bottom_k", "IO14_upsert_candles"]


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 200 and set(o) <= set(q) and len(o) > 0.9 * len(q)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, sf, name):
    status, n, _, msg = compare(name, spark, duck(sf), sf, entry.queries(), entry.oracle_sql())
    assert status == "ok", msg
