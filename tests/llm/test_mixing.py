"""Targets and the mixture against the same rules in SQL and in plain Python."""

import re

import duckdb
import numpy as np
import pytest

from barlens.llm import mixing
from pyspark.sql import functions as F

SCHEMA = "taken string, doc_id long, text string, source string, size int, rank int"


def filled(sizes, weights, epochs=3):
    """Deal shares by weight, cap them, deal the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = sum(sizes.values()), set()
    while True:
        level = (budget - sum(epochs * sizes[s] for s in full)) / max(1e-300, sum(w[s] for s in names if s not in full))
        more = {s for s in names if s not in full and epochs * sizes[s] <= level * w[s]}
        if not more:
            return {s: float(epochs * sizes[s]) if s in full else level * w[s] for s in names}
        full |= more


def rows_of(seed):
    rng = np.random.default_rng(seed)
    sources = ["a", "b", "Z", "é", None, "big", "tiny", "empty"]
    rows = []
    for i in range(400):
        s = "big" if rng.random() < 0.4 else sources[int(rng.integers(len(sources) - 2))]
        rows.append(("t", i, " ".join(["w"] * int(rng.integers(0, 60))) + rng.choice(["", " ", "\n"]), s, 1, 2))
    return rows + [("t", 900, "one two", "tiny", 1, 2), ("t", 901, None, "empty", 1, 2), ("t", 902, "", "empty", 1, 2)]


@pytest.mark.parametrize("seed,per_task", [(1, 20_000), (2, 8)])
def test_against_sql(spark, seed, per_task):
    rows = rows_of(seed)
    got = mixing.mix_documents(spark.createDataFrame(rows, SCHEMA), rows_per_task=per_task).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[1], r[2], r[3]) for r in rows])
    want = {r[0]: r for r in con.execute(mixing.OP10_SQL).fetchall()}
    assert {r.doc_id: (r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got} == want
    sizes, taken, largest = {}, {}, {}
    for r in got:
        assert r.size == len(re.findall("[^\x20\x09-\x0D]+", rows[r.doc_id if r.doc_id < 400 else r.doc_id - 500][2] or "")) and r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    targets = filled(sizes, mixing.WEIGHTS)
    assert all(abs(r.target - targets[r.source]) < 1e-6 for r in got)
    assert all(abs(taken[s] - targets[s]) <= 2 * largest[s] for s in sizes) and sum(taken.values()) <= sum(sizes.values())


def test_repeated_rows_and_mixture(spark):
    rows = rows_of(3)[:50] + [("t", 7, "one two three", "a", 1, 2)] * 4 + [("t", None, "x y", None, 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_documents(df).collect()
    assert len(got) == len(rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() > 0
    assert mixing.mixed(df).exceptAll(out).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([("t", 1, None, "a", 1, 2)], SCHEMA)
    assert [(r.size, r.taken, r.target) for r in mixing.mix_documents(df).collect()] == [(0, 0, 0.0)]
    assert mixing.mix_documents(df.limit(0)).collect() == [] and mixing.mixed(df).collect() == []
    assert mixing.mix_documents(df.where(F.lit(False))).columns[:3] == ["doc_id", "source", "size"]
