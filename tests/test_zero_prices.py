"""Bars that close at 0: returns, labels and checks as in the SQL."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.sql import functions as F

from barlens.functions.core import ieee_div
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def zeros(tmp_path_factory, sf):
    """The test tables with every seventh price 0."""
    import duckdb
    out = str(tmp_path_factory.mktemp("zeros"))
    for t in os.listdir(sf):
        if t == "events.parquet":
            duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 7 = 3 THEN 0.0 ELSE value END AS value) FROM '{sf}/{t}') TO '{out}/{t}' (FORMAT PARQUET)")
        else:
            os.symlink(f"{sf}/{t}", f"{out}/{t}")
    return out


@pytest.mark.parametrize("name", ["DQ4_dataset_audit", "DQ5_bar_sanity", "L5_leverage_label", "W59_swing_levels", "E1_forward_returns", "E2_rank_ic", "E4_turnover", "E7_per_feature_ic",
                                  "E3_top_bottom_spread", "E5_evaluate_factor", "E8_walk_forward_ic", "E10_dynamic_weights", "E11_leaderboard", "E15_direction_audit"])
def test_zero_prices_as_in_sql(spark, zeros, name):
    import __spark_entry__ as entry
    state, n, _, message = compare(name, spark, duck(zeros), zeros, entry.queries(), entry.oracle_sql())
    assert state == "ok" and n > 0, message


def test_division_by_zero_as_floating_point(spark):
    r = spark.range(1).select(*[ieee_div(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("p", 1.0, 0.0), ("m", -2.0, 0.0), ("z", 0.0, 0.0), ("q", 3.0, 2.0))]).first()
    assert r.p == math.inf and r.m == -math.inf and math.isnan(r.z) and r.q == 1.5
