"""Tree scores against a recursion over dictionaries of counts."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlens.llm import context_tree as ct
from barlens.llm.common import held_out

SCHEMA = "score string, doc_id long, text string, body int, n long"


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


class Tree:
    """Counts by (context, decision); weighted probabilities by recursion over the children that were seen."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.below = depth, {}, {}
        for t in texts:
            for context, byte in self.places(t):
                for node, bit in self.decisions(byte):
                    for d in range(depth + 1):
                        c = context[:d]
                        self.n.setdefault((c, node), [0, 0])[bit] += 1
                        if d:
                            self.below.setdefault((c[:-1], node), set()).add(c)
        self.memo = {}

    def places(self, text):
        s = b"\xff" * self.depth + text + b"\xff"
        return [(s[i - self.depth:i][::-1], s[i]) for i in range(self.depth, len(s))]

    @staticmethod
    def decisions(byte):
        node = 1
        for i in range(7, -1, -1):
            bit = byte >> i & 1
            yield node, bit
            node = node * 2 + bit

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, c, node):
        if (c, node) not in self.memo:
            a, b = self.n.get((c, node), (0, 0))
            own = self.kt(a, b)
            if len(c) == self.depth:
                self.memo[c, node] = own, None, own
            else:
                down = sum(self.weighted(x, node)[2] for x in self.below.get((c, node), ()))
                self.memo[c, node] = own, down, math.log(.5) + np.logaddexp(own, down)
        return self.memo[c, node]

    def one(self, context, node, d=0):
        c = context[:d]
        a, b = self.n.get((c, node), (0, 0))
        here = (b + .5) / (a + b + 1)
        if d == self.depth:
            return here
        own, down, all_ = self.weighted(c, node)
        w = math.exp(math.log(.5) + own - all_)
        return w * here + (1 - w) * self.one(context, node, d + 1)

    def score(self, text):
        out = 0.0
        for context, byte in self.places(text):
            for node, bit in self.decisions(byte):
                p = self.one(context, node)
                out += math.log10(p if bit else 1 - p)
        return out


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def brute(rows, depth):
    train = [lower(t) for d, t in rows if not is_held(d)]
    tree, counts, end = Tree(train, depth), {}, "end"
    def tokens(t):
        return [w for w in re.findall(rb"[^\x20\x09-\x0D]+", t)] + [end]
    for t in train:
        for w in tokens(t):
            counts[w] = counts.get(w, 0) + 1
    total, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        w = tokens(lower(t))
        out.append((d, is_held(d), len(w), sum(counts.get(x, 0) > 0 for x in w), total,
                    sum(math.log10((counts.get(x, 0) + 1) / (total + v + 1)) for x in w), tree.score(lower(t))))
    return out


def rows():
    rng = random.Random(3)
    words = ["the", "The", "and", "ing", "é", "日本", "aa\xa0b", "x" * 70, "😀"]
    out = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", ", "]) for _ in range(rng.choice([0, 1, 3, 20])))) for i in range(60)]
    return out + [(100, None), (101, ""), (102, " \t"), (103, "ÿþ ÿ"), (104, "b" * 500), (7, "again"), (7, "again"), (None, "no id"), (105, "\0\1 Z")]


def same(got, want):
    key = lambda r: (repr(r[0]), r[2], round(r[6], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("depth,levels,block,piece", [(3, 2, 1 << 20, 1 << 20), (5, 2, 200, 40), (4, 1, 50, 7), (2, 2, 1000, 100)])
def test_against_recursion(spark, depth, levels, block, piece):
    given = rows()
    df = spark.createDataFrame([("s", d, t, 1, 2) for d, t in given], SCHEMA)
    got = ct.tree_scores(df, held_out(F.col("doc_id"), 7, 2), depth, levels, block, piece).collect()
    same([tuple(r)[:7] for r in got], brute(given, depth))
    assert all(abs(r.bits_per_byte * r.n_bytes * math.log10(2) + r.score) < 1e-6 for r in got)
    assert sorted(r.n_bytes for r in got) == sorted(len(lower(t)) + 1 for _, t in given)


def test_probabilities_of_a_context_add_up(spark):
    seen = [(int.from_bytes(bytes([c, 97, 98, y]), "big"), n) for c in (97, 98) for y, n in ((97, 5), (98, 1), (255, 2))] + [(int.from_bytes(b"\xff\xff\xffa", "big"), 3)]
    asked = [(int.from_bytes(c + bytes([y]), "big"), 0) for c in (b"aab", b"zab", b"\xff\xff\xff") for y in range(256)]
    both = dict(asked) | dict(seen)
    got = {r.g: 10 ** r.log10_p for r in ct.probabilities(spark.createDataFrame(list(both.items()), "g long, n long"), depth=3).collect()}
    assert len(got) == len(both)
    for c in (b"aab", b"zab", b"\xff\xff\xff"):
        assert abs(sum(got[int.from_bytes(c + bytes([y]), "big")] for y in range(256)) - 1) < 1e-12


def test_edges(spark):
    df = spark.createDataFrame([("s", 9, "only held out", 1, 2)], SCHEMA)
    assert ct.tree_scores(df.limit(0), F.lit(False)).collect() == []
    r = ct.tree_scores(df, F.lit(True)).collect()[0]
    assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score) == (0, 0, 4, 0.0) and abs(r.bits_per_byte - 8) < 1e-12


def test_query_on_given_documents(spark, sf):
    rows = ct.op12_tree_scores(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.held_out == is_held(r.doc_id) for r in rows)
    held = [r for r in rows if r.held_out]
    shallow = ct.tree_scores(spark.read.parquet(f"{sf}/documents.parquet"), held_out(F.col("doc_id"), 7, 2), depth=1).where("held_out").collect()
    assert held and sum(r.score for r in held) > 1.2 * sum(r.score for r in shallow)
    assert sum(r.score for r in held) / sum(r.n_bytes for r in held) > -2.7 * math.log10(2)
    again = {r.doc_id: r.score for r in ct.op12_tree_scores(spark, sf).collect()}
    assert again == {r.doc_id: r.score for r in rows}
