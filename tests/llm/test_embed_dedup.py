"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from barlens.llm import embed_dedup

SCHEMA = "label string, vec_id long, embedding array<float>, node long, n long"


def brute(rows, threshold=0.9):
    """{row number: (vec_id, n_links, component_id, kept)}"""
    ids, vecs = [r[1] for r in rows], []
    for r in rows:
        v = r[2]
        ok = r[1] is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vecs.append(np.array(v, dtype=np.float32).astype(float) if ok else None)
    linked = {i: set() for i in range(len(rows))}
    for i, a in enumerate(vecs):
        for j in range(i):
            b = vecs[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                linked[i].add(j)
                linked[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min((ids[j] for j in seen), key=lambda x: (x is not None, x)) if ids[i] is not None else None
        out.append((ids[i], len(linked[i]), c, ids[i] == c))
    return sorted(out, key=repr)


def result(df, **options):
    return sorted((tuple(r) for r in embed_dedup.near_vectors(df, **options).collect()), key=repr)


@pytest.mark.parametrize("strip", [7, 8192])
def test_against_all_pairs(spark, strip, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 5)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows, n = [], 0
    for i, b in enumerate(base):
        for _ in range(1 + i % 4 * 2):
            rows.append(("x", n, (b + rng.normal(size=16) * rng.choice([0.0, 0.2, 0.45])).tolist(), 0, 0))
            n += 1
    # a chain, scaled copies, other lengths, and what links with nothing
    for a in range(8):
        rows.append(("x", 100 + a, [float(np.cos(a * .4)), float(np.sin(a * .4))] + [0.0] * 14, 1, 1))
    rows += [("x", 200, [1.0, 2.0], 0, 0), ("x", 201, [2.0, 4.0], 0, 0), ("x", 202, [1.0, 2.0, 0.0], 0, 0), ("x", 203, None, 0, 0),
             ("x", 204, [], 0, 0), ("x", 205, [0.0] * 16, 0, 0), ("x", 206, [float("nan")] + [1.0] * 15, 0, 0),
             ("x", 207, [float("inf")] + [1.0] * 15, 0, 0), ("x", 208, [None] + [1.0] * 15, 0, 0), (None, 209, [1e30, 2e30], 0, 0)]
    rows += [("x", 300 + i, rows[3][2], 0, 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, strip=strip) == brute(rows)


def test_empty_and_unlinked(spark):
    df = spark.createDataFrame([("x", 1, None, 0, 0), ("x", None, [1.0], 0, 0)], SCHEMA)
    assert result(df) == [(1, 0, 1, True), (None, 0, None, True)]
    assert result(df.limit(0)) == []


def test_different_vectors_under_one_id(spark):
    rows = [("x", i, v, 0, 0) for i, v in [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.05]), (7, [1.0, 0.06]), (3, [0.0, 2.0]), (3, [-1.0, 0.0]), (7, [1.0, 0.06])]]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) and [r for r in got if r[0] == 5] == [(5, 1, 3, False), (5, 3, 5, True)]


def test_table(spark, sf):
    rows = [("", r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in embed_dedup.op1_embed_near_dedup(spark, sf).collect()), key=repr) == brute(rows)
