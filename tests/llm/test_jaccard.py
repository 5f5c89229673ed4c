"""Jaccard join against all pairs of shingle sets."""

import re

import numpy as np
import pyarrow as pa
import pytest

from barlens.llm import jaccard, shingles

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "node long, doc_id long, text string, token string, n long"


def sets_of(text, k=5):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=80):
    sets = [sets_of(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least[root(i)] if doc is not None else None) for i, (doc, _) in enumerate(rows)), key=repr)


def result(df, **options):
    return sorted((tuple(r) for r in jaccard.similar_documents(df, **options).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(1, d, t, "x", 2) for d, t in rows], SCHEMA)


def test_shingle_values():
    texts = ["a b c d e f", "A  b\tC\nd e f", "a b", "ab", None, "", " \n ", "a b c d e", "é a", "x" * 9 + " y"] + ["w%d" % i for i in range(50)]
    got = list(shingles.shingle_sets(pa.array(texts)))
    assert [len(x) for x in got] == [len(sets_of(t)) for t in texts]
    assert (got[0] == got[1]).all() and len({x.tobytes() for x in got}) == len({frozenset(sets_of(t)) for t in texts})
    assert [x.tolist() for x in shingles.shingle_sets(pa.array(texts).slice(3, 5))] == [x.tolist() for x in got[3:8]]


def test_long_text(monkeypatch):
    text = " ".join(str(i * 7919 % 1013) for i in range(4000)) + " " + "z" * 3000 + " tail of it all here"
    whole = next(shingles.shingle_sets(pa.array([text])))
    monkeypatch.setattr(shingles, "BLOCK", 1000)
    assert (next(shingles.shingle_sets(pa.array([text]))) == whole).all() and len(whole) == len(sets_of(text))


@pytest.mark.parametrize("seed,sent", [(1, 1 << 20), (2, 0)])
def test_against_all_pairs(spark, seed, sent, monkeypatch):
    monkeypatch.setattr(jaccard, "SENT_IDS", sent)
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 256)
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    rows, passage = [(900, None), (901, ""), (902, " \t"), (903, "One Two"), (904, "one  two"), (905, "one two three"), (None, "one two"), (906, "a b c d e"), (907, "a b c d e f")], word(60)
    doc = 0
    for family in range(14):
        base = word(int(rng.choice([4, 8, 30, 120, 400])))
        if family % 3 == 0:
            base = base + passage
        for _ in range(int(rng.integers(1, 14))):
            w = list(base)
            for _ in range(int(rng.integers(0, 1 + max(1, len(w) // 30)))):
                w[int(rng.integers(len(w)))] = word(1)[0]
            rows.append((doc, " ".join(w)))
            doc += 1
    rows += [(2000 + i, rows[20][1].upper()) for i in range(30)] + [rows[25]] * 3
    assert result(frame(spark, rows)) == brute(rows)


def test_empty(spark):
    assert result(frame(spark, [(1, None)])) == [(1, 0, 1)]
    assert result(frame(spark, [(1, None)]).limit(0)) == []


def test_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in jaccard.op4_jaccard_join(spark, sf).collect()), key=repr) == brute(rows)


def test_few_words_in_all():
    for k in range(1, 8):
        for n in range(8):
            text = " ".join("w%d" % i for i in range(n))
            for texts in ([text], [text, "", None], [None, *text.split()]):
                assert [len(x) for x in shingles.shingle_sets(pa.array(texts, pa.string()), k)] == [len(sets_of(t, k)) for t in texts], (k, n)


@pytest.mark.parametrize("n", range(6))
def test_table_of_few_words(spark, n):
    rows = [(1, " ".join("w%d" % i for i in range(n))), (2, ""), (3, None)]
    assert result(frame(spark, rows).coalesce(1)) == brute(rows)
