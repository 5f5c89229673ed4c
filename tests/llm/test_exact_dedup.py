"""Exact duplicates against a dictionary of normalised texts."""

import hashlib
import re

import pytest

from barlens.llm import exact_dedup

SCHEMA = "norm string, doc_id long, text string, part int, sha string"


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    out = []
    for norm, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is not None, x))
        out += [(doc, ids[0], len(ids), i == 0, hashlib.sha256(norm.encode()).hexdigest()) for i, doc in enumerate(ids)]
    return sorted(out, key=repr)


ROWS = ([(i, "hot text") for i in range(60)] + [(100 + i, None if i % 2 else "") for i in range(9)] + [(200, " "), (201, "\t\n"), (202, "a\xa0b"), (203, "a b")]
        + [(300 + i, "p" * 200 + str(i // 2)) for i in range(20)] + [(400, "x" * 100_000), (401, "x" * 100_000), (402, "x" * 99_999)]
        + [(500, "twice"), (500, "twice"), (500, "other"), (None, "hot text"), (None, "alone"), (601, "é  é"), (600, "é\té")])


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_against_dictionary(spark, parts):
    df = spark.createDataFrame([("x", d, t, 7, "y") for d, t in ROWS], SCHEMA)
    got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(df, parts).collect()), key=repr)
    assert got == brute(ROWS)


def test_one_text_in_all_partitions(spark):
    rows = [(i, "same") for i in range(500)]
    df = spark.createDataFrame([("x", d, t, 7, "y") for d, t in rows], SCHEMA)
    assert {(r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(df, 16).collect()} == {(0, 500)}


def test_empty_and_kept_rows(spark):
    df = spark.createDataFrame([("x", d, t, 7, "y") for d, t in ROWS], SCHEMA)
    assert exact_dedup.exact_duplicates(df.limit(0)).collect() == []
    kept = exact_dedup.deduplicated(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted((r[0] for r in brute(ROWS) if r[3]), key=repr)  # one row of each text


def test_a_shard_read_twice(spark):
    rows = [("a", i % 7, f"text {i % 7}", 1, "s") for i in range(700)] + [("b", 3, "text  3", 2, None), ("0", 3, "text 3", 0, "s"), ("z", None, "no id", 1, "s"), ("y", None, "no id", 1, "s")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    kept = exact_dedup.deduplicated(df)
    assert sorted((r.doc_id, r.norm) for r in kept.collect() if r.doc_id is not None) == [(i, "0" if i == 3 else "a") for i in range(7)]
    assert [r.norm for r in kept.collect() if r.doc_id is None] == ["y"]
