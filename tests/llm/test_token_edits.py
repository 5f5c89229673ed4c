"""Counts after edits against encoding the edited text afresh."""

import numpy as np
import pytest

from barlens.llm import bpe, token_edits as te

POOL = list(" \n\t'sStTlLabc019.,!\"é漢😀\xa0 \x1c") + ["the ", " and", "'ll", "  ", "\n\n ", "<|endoftext|>", "don't "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_random_edits(library, monkeypatch):
    monkeypatch.setattr(te, "LEAF", 3)
    enc, rng = bpe.loaded(open(bpe.default_tokenizer(), encoding="utf-8").read()), np.random.default_rng(8)
    for _ in range(150):
        text = "".join(rng.choice(POOL, rng.integers(0, 120)))
        tree = te.CountTree(enc, text)
        for _ in range(12):
            a = int(rng.integers(-2, len(text) + 3))
            b = a + int(rng.integers(0, 12))
            new = "".join(rng.choice(POOL, rng.integers(0, 6)))
            lo = max(0, min(a, len(text)))
            text = text[:lo] + new + text[max(lo, min(b, len(text))):]
            tree.replace(a, b, new)
            assert tree.text() == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_only_touched_regions():
    enc = bpe.loaded(open(bpe.default_tokenizer(), encoding="utf-8").read())
    tree = te.CountTree(enc, "some words of a text " * 20_000)
    tree.encoded = 0
    tree.replace(200_000, 200_003, "new")
    assert 0 < tree.encoded < 40


def test_frames(spark, library):
    rows = [("n", 1, "some text here", 5), ("n", 2, None, 5), ("n", 3, "", 5), ("n", 4, "x" * 20_000, 5), ("n", 4, "x" * 20_000, 5), ("n", None, "a b", 5)]
    df = spark.createDataFrame(rows, "chars string, doc_id long, text string, tokens int")
    edits = spark.createDataFrame([(1, 2, 0, 4, "none"), (1, 1, 5, 9, "long story"), (3, 1, 3, 9, "grown"), (4, 1, 10, 19_000, None)], "doc_id long, nr int, start int, stop int, new string")
    got = te.edited(te.with_edits(te.count_trees(df), edits)).collect()
    want = {1: "none long story here", 2: "", 3: "grown", 4: "x" * 1010, None: "a b"}
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.doc_id] and r.n_tokens == sum(r.tokens) == len(library.encode(want[r.doc_id]).ids) and sum(r.chars) == len(r.text)
    assert te.edited(te.with_edits(te.count_trees(df.limit(0)), edits)).collect() == []


def test_documents(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = te.op5_token_edits(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text, n = docs[r.doc_id], len(docs[r.doc_id])
        after = text[:n // 3] + text[n // 3 + 7:]
        after = after[:n // 2] + text[:24] + after[n // 2:]
        after = after[:n // 4] + text[n // 4:n // 4 + 40].upper() + after[n // 4 + 40:]
        assert (r.n_before, r.n_after, r.chars_after) == (len(library.encode(text).ids), len(library.encode(after).ids), len(after))
