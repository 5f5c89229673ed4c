"""Each stage of the pipeline against a brute-force version on what the stage before it kept."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from barlens.llm import bpe, mixing, toxicity
from test_jaccard import brute as similar


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf).collect()
        out.append(rows)
        if stage is not corpus_pipeline.encode:
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_filters(spark, sf, stages):
    start, clean, unique, single = stages[:4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "BPE"]
    assert all(r.__fields__ == start[0].__fields__ for rows in stages[1:5] for r in rows[:1])
    assert {r.doc_id for r in clean} == {r.doc_id for r in toxicity.op2_toxicity(spark, sf).collect() if not r.predicted}
    first = {}
    for r in clean:
        norm = re.sub("[\x20\x09-\x0D]+", " ", r.text or "")
        first[norm] = min(first.get(norm, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in unique) == sorted(first.values())
    assert sorted(r.doc_id for r in single) == sorted(d for d, _, c in similar([(r.doc_id, r.text) for r in unique]) if d == c)


def test_mixture_and_tokens(spark, sf, stages):
    from tokenizers import Tokenizer
    single, mixture, tokens = stages[3:]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in single])
    want = {d: taken // size for d, size, _, _, taken in con.execute(mixing.OP10_SQL).fetchall() if taken}
    assert Counter(r.doc_id for r in mixture) == want
    library, text = Tokenizer.from_file(bpe.default_tokenizer()), {r.doc_id: r.text for r in mixture}
    assert Counter(r.doc_id for r in tokens) == want
    for r in tokens:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())


def test_run_is_the_stages(spark, sf, stages):
    got = sorted(tuple(r) for r in entry.queries()["pipeline"](spark, sf).collect())
    assert got == sorted(tuple(r) for r in stages[-1])


def test_odd_documents_through_the_whole_run(spark, sf, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, extra columns with names used inside; then an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, norm string, component string, taken long"
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "plain words of a first document here", "en", "a", 1, "x", "y", 9), (1, "plain words of a first document here", "en", "a", 1, "x", "y", 9), (2, None, None, None, None, None, None, None),
            (3, "", "en", "b", 0, "x", "y", 9), (None, "no id but some words in it", "en", None, 1, "x", "y", 9), (4, long, "en", "b", 1, "x", "y", 9), (5, long + " more", "en", "a", 1, None, "y", 9),
            (6, " \t\n", "de", "b", 3, "x", "y", 9), (7, "short", "de", "c", 5, "x", "y", 9), (7, "another text under one id", "de", "c", 5, "x", "y", 9)]
    for name, some in (("odd", rows), ("none", [])):
        path = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(str(path / "documents.parquet"))
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(path / "labels.parquet"))
        docs = spark.read.parquet(str(path / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, str(path))
        kept = [r.doc_id for r in docs.collect()]
        assert sorted(kept, key=repr) == sorted([None, 1, 2, 4, 6, 7, 7] if some else [], key=repr)
        got = corpus_pipeline.run(spark, str(path)).collect()
        # the mixture takes whole documents within its budget of words, so not each of them
        assert {r.doc_id for r in got} <= set(kept) and bool(got) == bool(some)
