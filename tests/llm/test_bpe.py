"""Encoding and decoding against the tokenizers library, byte for byte."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from barlens.llm import bpe

EDGES = ["", None, " ", "  a", "a  b", "a \n b\n\n c", "\n  x", "don't I'll 's", "!'s x", "x'sZ qZ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "é ñ ß 漢字 😀😀",
         "a\xa0b \xa0 c", " x  y", "a\x1cb \x1d c", "\x85x", "tab\tand\x0bvt\x0cff\r\n", "a" * 5000, "ab" * 3000 + "." * 4000, "12345 678.90", "x" + " " * 300 + "y", "\x00\x01 �"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_tokenizer())


def check(rows, texts, library):
    assert len(rows) == len(texts)
    for doc, n, ids_sha, text_sha in rows:
        text = texts[doc] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert n == len(ids), (doc, text[:80])
        assert ids_sha == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), (doc, text[:80])
        assert text_sha == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), (doc, text[:80])


def test_edges(spark, library):
    schema = T.StructType([T.StructField("n_tokens", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    df = spark.createDataFrame([("clash", i, t) for i, t in enumerate(EDGES)] * 2, schema)
    rows = [tuple(r) for r in bpe.digests(df).collect()]
    assert sorted(rows, key=repr)[::2] == sorted(rows, key=repr)[1::2]
    check(sorted(rows, key=repr)[::2], dict(enumerate(EDGES)), library)
    assert bpe.digests(df.limit(0)).collect() == []


def test_random_unicode(library):
    rng = np.random.default_rng(5)
    enc = bpe.loaded(open(bpe.default_tokenizer(), encoding="utf-8").read())
    pool = list(" \n\t'sStTlLdDmMrRvVeEabc019.,!-_\"é漢😀\xa0 \x1c\x85") + ["the ", " and", "'ll", "  "]
    for _ in range(1500):
        t = "".join(rng.choice(pool, size=rng.integers(1, 60)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == np.array(ids, dtype="<u4").tobytes(), repr(t)
        assert enc.decode(enc.encode(t)) == library.decode(ids, skip_special_tokens=False)


def test_documents(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check([tuple(r) for r in bpe.op8_bpe(spark, sf).collect()], docs, library)
