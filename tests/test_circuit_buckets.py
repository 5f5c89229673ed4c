"""The rolling circuit works on buckets of a mode: no mode is one group, and tails carry over buckets and batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.streaming import streams as ST


def _trades(size: int) -> pd.DataFrame:
    rng = np.random.default_rng(size)
    hours = np.sort(rng.integers(0, 24 * 40, size))
    return pd.DataFrame({"mode": rng.choice(["A", "B", "C"], size, p=[0.9, 0.08, 0.02]), "order_id": [f"{i:05d}" for i in range(size)], "hour": hours,
                         "closed_at": pd.to_datetime("2024-01-01") + pd.to_timedelta(hours, unit="h"), "realized_r": np.where(rng.random(size) < 0.1, 0.0, rng.normal(-0.7, 1, size))})


def _want(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    out = []
    for _, g in pdf.sort_values(["closed_at", "order_id"]).groupby("mode"):
        lost = (g.realized_r <= 0).tolist()
        for i, o in enumerate(g.order_id):
            seen = lost[max(0, i - n + 1):i + 1]
            streak = next((k for k, x in enumerate(reversed(seen)) if not x), len(seen))
            out.append((o, 100.0 * sum(seen) / len(seen), streak, len(seen)))
    return pd.DataFrame(out, columns=["order_id", "failure_rate", "loss_streak", "analyzed"]).set_index("order_id").sort_index()


def _same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    got = got.set_index("order_id").sort_index()[list(want.columns)]
    assert got.index.equals(want.index)
    assert np.allclose(got.to_numpy(float), want.to_numpy(float))


@pytest.mark.parametrize("n", [1, 7, 60])
def test_batches_of_buckets_and_their_carry(spark, n):
    pdf = _trades(700)
    df = spark.createDataFrame(pdf).withColumn("lost", F.col("realized_r") <= 0)
    made, carry = [], None
    for lo, hi in ((0, 10), (10, 10), (10, 11), (11, 99)):
        day = F.floor(F.col("hour") / 24)
        b = df.where((day >= lo) & (day < hi)).groupBy("mode", F.date_trunc("day", "closed_at").alias("bucket")).agg(F.collect_list(F.struct("closed_at", "order_id", "lost")).alias("rows"))
        rows, carry = ST._circuit_buckets(b, carry, n)
        made.append(rows.toPandas())
        assert all(len(r.tail) <= n - 1 for r in carry.collect())
    _same(pd.concat(made), _want(pdf, n))


def test_stream_groups_by_mode_and_bucket(spark, tmp_path):
    pdf = _trades(400).drop(columns="hour")
    path = str(tmp_path / "trades")
    spark.createDataFrame(pdf).repartition(3).write.parquet(path)
    b = ST.Bounded(ST.folder_stream(spark, path, spark.read.parquet(path).schema, 1), "closed_at")
    circuit = ST.rolling_circuit_state(b.rows, n=20, delay="60 days")
    assert {"mode", "bucket"} <= set(circuit.stream.columns)  # what waits is kept per mode and bucket, not per mode
    _same(ST.run_to_table(circuit, "circuit", closing=[b]).toPandas(), _want(pdf, 20))


def test_no_trade_at_all(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "mode string, closed_at timestamp, order_id string, realized_r double").write.parquet(path)
    b = ST.Bounded(ST.folder_stream(spark, path, spark.read.parquet(path).schema), "closed_at")
    assert ST.run_to_table(ST.rolling_circuit_state(b.rows), "circuit", closing=[b]).count() == 0
