"""Lexicon matching against edit distances, contexts, and held-out accuracy on planted words."""

import zlib

import numpy as np

from barlens.llm import toxicity as tx

SCHEMA = "score string, doc_id long, text string, toxic string, lang string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(entries, word):
    best = None
    for i, e in enumerate(entries):
        k, stem = tx.allowed_edits(e), e.rstrip("*")
        d = min(distance(stem, word[:n]) for n in range(len(word) + 1)) if e.endswith("*") else distance(stem, word)
        if d <= k and (best is None or (d, i) < best):
            best = (d, i)
    return best


def test_matcher():
    entries = ["stem*", "longstem*", "word", "words", "idiotic", "worthless", "scum", "pathetically"]
    m, rng = tx.Matcher(entries), np.random.default_rng(3)
    for _ in range(6000):
        w = list(rng.choice([e.rstrip("*") for e in entries]))
        for _ in range(rng.integers(0, 4)):
            at, kind = int(rng.integers(0, len(w) + 1)), rng.integers(3)
            if kind == 0:
                w.insert(at, rng.choice(list("abstemiowrd")))
            elif at < len(w):
                w[at:at + 1] = [] if kind == 1 else [rng.choice(list("abstemiowrd"))]
        w = "".join(w) + rng.choice(["", "", "s", "ings"])
        if w:
            got, want = m.match(w), brute(entries, w)
            assert (got and got[0]) == (want and want[0]), (w, got, want)


def test_context():
    m = tx.Matcher(["scoundrel"])
    at = lambda t: [(d, c) for _, d, c in m.hits(t)]
    assert at("a scoundrel there") == [(0, "plain")] and at("you scoundrel") == [(0, "direct")]
    assert at('the text has "the scoundrel" in it') == [(0, "quoted")] and at("he wrote scoundrel") == [(0, "reported")]
    assert at("SCOUNDREl") == [(0, "plain")] and at("a sc0undrel") == [(1, "plain")] and at("") == []
    one = lambda t: tx._score(m.hits(t), {}, 0.0)
    assert one('it says "scoundrel" here') < tx.THRESHOLD < one("you scoundrel") and one("a scoundrel") > one("he wrote scoundrel")


def planted(n=700, seed=4):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrst"))
    word = lambda: "".join(rng.choice(letters, rng.integers(2, 9)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(3, 60)))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(int(rng.integers(1, 4))):
                bad = rng.choice(["zzvillain", "zzrotter", "vvcad" + word()])
                if rng.random() < 0.15 and bad[0] == "z":
                    bad = bad[:4] + "x" + bad[5:]
                words.insert(int(rng.integers(len(words) + 1)), bad)
        docs.append(("s", i, " ".join(words), "t", "x"))
        if i % 5:
            labels.append((i, toxic))
    toxic_of = dict(labels)
    return docs + [("s", n, None, "t", None), ("s", n + 1, "", None, "x"), ("s", None, "you zzvillain", "t", "x"), ("s", 3, docs[3][2], "t", "x")], labels, toxic_of


def test_held_out(spark):
    docs, labels, toxic_of = planted()
    df = spark.createDataFrame(docs, SCHEMA)
    model = tx.learn(df, spark.createDataFrame([(d, t, "x") for d, t in labels], "doc_id long, toxic int, text string"))
    assert {"zzvillain", "zzrotter"} <= set(model["entries"]) and any(e.startswith("vvcad"[:4]) for e in model["entries"])
    rows = tx.scores(df, model).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, toxic_of[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic_of]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert all(r.predicted == 0 for r in rows if r.doc_id in (700, 701)) and [r.predicted for r in rows if r.doc_id is None] == [1]
    kept = tx.without_toxic(df, df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in rows if not r.predicted), key=repr)


def test_no_labels(spark):
    df = spark.createDataFrame([("s", 1, "any text", "t", "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in tx.scores(df, tx.learn(df, none)).collect()] == [0]
    assert tx.scores(df.limit(0), tx.learn(df.limit(0), none)).collect() == []


def test_other_labels_and_both(spark):
    """Labels other than 0 and 1 are none; a document with both is toxic; repeated labels count once."""
    docs, labels, _ = planted()
    df = spark.createDataFrame(docs, SCHEMA)
    schema = "doc_id long, toxic int"
    toxic = [d for d, t in labels if t][:40]
    plain = tx.learn(df, spark.createDataFrame(labels, schema))
    odd = tx.learn(df, spark.createDataFrame(labels + [(d, 0) for d in toxic] + labels[:50] + [(d, 2) for d, _ in labels] + [(d, -1) for d, _ in labels[:9]] + [(5, None)], schema))
    assert odd == plain


def test_contexts_are_learned(spark):
    """Where labelled texts quote a term without abuse, a quoted hit counts little; where they do not, it counts what is believed before."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    def text(hit):
        words = [word() for _ in range(40)]
        return " ".join(words[:20] + [hit] + words[20:])
    abuse = [(i, text("zzvillain"), 1) for i in range(300)]
    quoting = [(1000 + i, text('"zzvillain"'), 0) for i in range(80)]
    clean = [(2000 + i, text(word()), 0) for i in range(2000)]
    def learned(rows):
        df = spark.createDataFrame([("s", d, t, "t", "x") for d, t, _ in rows], SCHEMA)
        return tx.learn(df, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    with_quotes, without = learned(abuse + quoting + clean), learned(abuse + clean)
    assert with_quotes["context"]["quoted"] < 0.1 < without["context"]["quoted"] == tx.CONTEXT["quoted"]
    assert with_quotes["context"]["plain"] > 0.8 and with_quotes["entries"] == without["entries"] == ("zzvillain",)


def test_long_text(spark):
    docs, labels, _ = planted()
    model = tx.learn(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    long = "calm words of no harm " * 150_000
    df = spark.createDataFrame([("s", 1, long, "t", "x"), ("s", 2, long + "you zzvillain", "t", "x")], SCHEMA)
    assert {r.doc_id: r.predicted for r in tx.scores(df, model).collect()} == {1: 0, 2: 1}
