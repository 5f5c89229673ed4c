"""Prefix work, quantiles and drawdowns compute their input once, whatever the slices."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlens.operators import portfolio as PF
from barlens.plans.ordered import running
from barlens.plans.quantiles import exact_quantiles

N = 3000


@pytest.fixture()
def counted(spark):
    """Rows (i, r, g, wide) and how often a row of them was computed."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(N).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(2001)) / 1000.0 - 1.0).alias("r"),
                               F.array_compact(F.array(F.lit("all"), F.when(F.col("id") % 3 == 0, F.lit("third")))).alias("g"))
    return df.mapInArrow(look, df.schema), seen


def test_running_reads_its_input_once(counted):
    df, seen = counted
    got = running(df, [], ["i"], {"s": ("sum", F.col("r"))}, rows_per_slice=200).orderBy("i").toPandas()
    assert seen.value == N and np.allclose(got.s, np.cumsum(got.r))


def test_quantiles_read_their_input_once(counted):
    df, seen = counted
    q = exact_quantiles(df, [], "r", {"m": 0.5}, rows_per_slice=200).first().m
    assert seen.value == N and abs(q - np.median([r.r for r in df.select("r").collect()])) < 1e-12


def test_drawdown_multiplies_groups_behind_the_shuffle(counted):
    df, seen = counted
    dd = PF.max_drawdown(df, ["k"], ["i"], "r", "d", rows_per_slice=170, groups=F.transform("g", lambda z: F.struct(z.alias("k"))))
    got = {r.k: r.d for r in dd.collect()}
    assert seen.value == N
    pdf = df.orderBy("i").toPandas()
    for k in ("all", "third"):
        e = np.concatenate([[0.0], np.cumsum([r for r, g in zip(pdf.r, pdf.g) if k in g])])
        assert abs(got[k] - (np.maximum.accumulate(e) - e).max()) < 1e-9
