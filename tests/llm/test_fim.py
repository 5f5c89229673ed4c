"""Fill-in-the-middle samples against plain slicing, SQL and an exact round trip."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barlens.llm import fim

SCHEMA = "output string, doc_id long, text string, form string, n int, c0 int"


def brute(doc, text, unit=r"."):
    text = text or ""
    units = [m.group() for m in re.finditer(unit, text, re.DOTALL)]
    s, n = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest(), len(units)
    h = [int(s[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (doc, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return (doc, n, "spm" if spm else "psm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{x}<M>{m}")


def rows():
    rng = random.Random(5)
    out = [(i, "".join(rng.choice("ab é\n\t日😀<>PSḾ") for _ in range(rng.choice([1, 2, 3, 40, 400])))) for i in range(150)]
    return out + [(200, None), (201, ""), (202, "x<S>y"), (203, "<P"), (204, "<" * 50), (205, "S>" * 40), (206, "é" * 300_000), (207, "<P>"),
                  (208, "\0a\r\n"), (None, "no id at all"), (5, "again"), (5, "again"), (-7, "negative id")]


@pytest.mark.parametrize("unit", [None, r"[^ \t\n]+[ \t\n]*|[ \t\n]+"])
def test_against_slicing(spark, unit):
    given = rows()
    df = spark.createDataFrame([("o", d, t, "f", 1, 2) for d, t in given], SCHEMA)
    made = fim.fill_in_middle(df, unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((brute(d, t, unit or ".") for d, t in given), key=repr)
    assert sorted((tuple(r)[:6] for r in made), key=repr) == want
    assert sorted(r.back for r in made) == sorted(t or "" for _, t in given)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_lists_reach_every_rank():
    lanes = fim.Lanes()
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 64, 999, 5000):
        widths = rng.integers(1, 9, n)
        units, ends = fim.SkipList(lanes, widths), np.concatenate([[0], np.cumsum(widths)])
        assert [units.chars_before(r) for r in range(n + 1)] == ends.tolist()
        assert len(units.lanes) == 1 or len(units.lanes[1][0]) < n
        for lane, _, _ in units.lanes:
            assert lane.sum() == n


def test_query_against_sql_and_edges(spark, tmp_path):
    given = rows()
    df = spark.createDataFrame([("o", d, t, "f", 1, 2) for d, t in given], SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = fim.op11_fim(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(fim.OP11_SQL).fetchall()
    assert got.columns == [c[0] for c in con.description]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert fim.fill_in_middle(df.limit(0)).collect() == []
