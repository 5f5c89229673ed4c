"""Product codes against plain Lloyd rounds in whole numbers, and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from barlens.llm import vector_codes as vc

SCHEMA = "code string, vec_id long, embedding array<float>, label int, x int, error int"


def brute(rows, parts=8, k=16, rounds=6):
    fine = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v, _ in fine]
    w = len(ints[0]) // parts
    first = {}
    for (i, v, _), x in zip(fine, ints):
        if i not in first or v < first[i][0]:
            first[i] = (v, x)
    start = [first[i][1] for i in sorted(first, key=lambda i: (i is None, i))[:k]]
    books = [[x[p * w:p * w + w] for x in start] for p in range(parts)]

    def nearest():
        out = []
        for x in ints:
            d = [[sum((a - c) ** 2 for a, c in zip(x[p * w:p * w + w], e)) for e in books[p]] for p in range(parts)]
            out.append([(min(r), r.index(min(r))) for r in d])
        return out
    for _ in range(rounds):
        a = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p * w:p * w + w] for x, r in zip(ints, a) if r[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    a = nearest()
    err = [sum(d for d, _ in r) for r in a]
    per = {}
    for (_, _, lab), e in zip(fine, err):
        per[lab] = per.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for _, c in r), e, per[lab], sha) for (i, _, lab), r, e in zip(fine, a, err)), key=repr)


def rows_of(seed, n, spread=0.02, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(int(i), [float(np.float32(x)) for x in centres[rng.integers(12)] + spread * rng.normal(size=dim)], int(rng.integers(3)) if i % 5 else None)
            for i in rng.permutation(n)]
    rows += [(n + i, rows[0][1], 0) for i in range(n // 3)]  # a group of copies
    rows += [(9001, None, 1), (9002, [], 1), (9003, [1.0] * (dim - 1) + [float("nan")], 1), (9004, [1.0] * (dim - 1) + [None], 1),
             (9005, [float("inf")] + [0.0] * (dim - 1), 1), (9006, [0.0] * dim, 7), (3, rows[1][1], 1), (3, rows[1][1], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([("c", i, v, lab, 1, 2) for i, v, lab in rows], SCHEMA)


@pytest.mark.parametrize("seed,n,spread,bounds", [(1, 200, 0.02, None), (2, 120, 1.0, 1), (3, 90, 0.3, 9), (4, 10, 0.3, None)])
def test_against_plain_rounds(spark, tmp_path, seed, n, spread, bounds, monkeypatch):
    rows = rows_of(seed, n, spread)
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    whole = vc.compress
    monkeypatch.setattr(vc, "compress", lambda v: whole(v, bounds=bounds))
    monkeypatch.setattr(vc, "COMMON", 3)
    got = sorted((tuple(r) for r in vc.op13_vector_codes(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)


def test_ties_and_large_values(spark, tmp_path):
    rows = [(i, [float((i * j) % 3) for j in range(8)], 0) for i in range(40)] + [(100 + i, [30000.0 + i, -30000.0] * 4, 1) for i in range(6)]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((tuple(r) for r in vc.op13_vector_codes(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)


def test_against_sql(spark, sf):
    got = vc.op13_vector_codes(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(vc.OP13_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_bounds_save_work_and_shrink():
    rng = np.random.default_rng(7)
    x = rng.integers(-4000, 4000, (2000, 8))
    first = vc.Codebook(x[None, :16].copy())
    code, near, low, _ = vc._anew(x, first.entries[0], 4)
    book = first.updated(np.concatenate([np.stack([np.append(x[code == e].sum(axis=0), (code == e).sum()) for e in range(16)])])[None])
    new, near, low, best, need = vc._reassign(x, book, 0, code, near, low, 4)
    d = ((x[:, None, :] - book.entries[0]) ** 2).sum(axis=2)
    assert (new == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    for _ in range(12):
        sums = np.stack([np.append(x[new == e].sum(axis=0), (new == e).sum()) for e in range(16)])[None]
        book = book.updated(sums)
        new, near, low, best, need = vc._reassign(x, book, 0, new, near, low, 3)
        d = ((x[:, None, :] - book.entries[0]) ** 2).sum(axis=2)
        assert (new == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        rest = np.sort(d, axis=1)[:, 1:]
        assert (low.min(axis=1).astype(float) ** 2 <= rest[:, 0]).all()
    assert (need == 0).mean() > 0.3 and (need <= 3).mean() > 0.9
    assert vc._fewer(np.array([[90, 6, 4, 0, 0, 0]]), 4, 1) == 1 and vc._fewer(np.array([[0, 0, 0, 0, 0, 9]]), 4, 2) == 4


def test_edges(spark):
    df = frame(spark, [(None, [0.5, 1.0, 2.0], None), (4, [0.5, 1.5, 2.0], 1), (5, [0.5, 1.5], 1), (6, [1e30, 0.0, 0.0], 1)])
    out, books = vc.compress(df, parts=2)
    assert books.shape == (2, 2, 2) and sorted((r.vec_id, bytes(r.code), r.error) for r in out.collect() if r.vec_id) == [(4, b"\0\0", 0)]
    assert out.count() == 2
    for empty in (df.limit(0), frame(spark, [(1, None, 1), (2, [float("nan")], None)])):
        out, books = vc.compress(empty)
        assert out.collect() == [] and books.size == 0 and vc.with_label_error(out).collect() == []
