"""Language identification: features of long texts, edge cases, held-out accuracy."""

import zlib

import numpy as np

from barlens.llm import langid


def test_features(monkeypatch):
    text = "Ünder the  Bridge, 12 été ñandú. " * 40
    whole = langid.features(text)
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert np.allclose(whole, langid.features(text)) and abs((whole ** 2).sum() - 1) < 1e-9
    assert langid.features(None) is None and langid.features("") is None and langid.features("12 ,.") is None and langid.features("\u0301\u0302 \u0300") is None and langid.features("x") is not None


def test_families():
    assert langid.family_of("en") == langid.family_of("de-AT") == "germanic" and langid.family_of("fr") == "romance" and langid.family_of("qqq") == "qqq"


def test_edges(spark):
    words = {"en": "the and of which that with", "de": "und der nicht auch werden über", "fr": "est qui dans être leurs où", "qx": "zzk kkz zkzk kzz"}
    rng = np.random.default_rng(2)
    rows = [("r", i, " ".join(rng.choice(w.split(), 8)), lang, "s") for i, (lang, w) in enumerate(list(words.items()) * 40)]
    odd = [("r", 900, None, "en", "s"), ("r", 901, "", "en", "s"), ("r", 902, "12 34!", None, "s"), ("r", None, "der und nicht auch", "de", "s"), ("r", 903, "und nicht", None, "s"), rows[0]]
    df = spark.createDataFrame(rows + odd, "score string, doc_id long, text string, lang string, family string")
    got = langid.predictions(df, langid.learn(df)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "de", "de"]
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    lang = {r[1]: r[3] for r in rows}
    assert all(r.lang_pred == lang[r.doc_id] for r in got if r.doc_id in lang)
    assert langid.predictions(df.limit(0), langid.learn(df.limit(0))).collect() == []
    assert {r.lang_pred for r in langid.predictions(df, langid.learn(df.limit(0))).collect()} == {"und"}


def test_decisions_against_a_plain_reading(spark, sf):
    """Family by votes of its machines, then the language by votes within it, read off the fitted weights one text at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(docs)
    got = {r.doc_id: r.lang_pred for r in langid.predictions(docs, model).collect()}
    assert set(got.values()) <= {r.lang for r in docs.select("lang").distinct().collect()} | {"und"}
    for r in docs.limit(60).collect():
        assert got[r.doc_id] == plain_decision(model, r.text)


def plain_decision(model, text):
    x = langid.features(text)
    if x is None:
        return "und"
    speaks = {}  # (a, b) -> how far the machine speaks for a
    for k, (_, a, b) in enumerate(model["machines"]):
        d = sum(float(v) * float(w) for v, w in zip(x, model["weights"][:, k]) if v) + float(model["bias"][k])
        speaks[a, b], speaks[b, a] = d, -d

    def winner(names):
        won = {a: (sum(speaks[a, b] > 0 for b in names if b != a), sum(speaks[a, b] for b in names if b != a)) for a in names}
        return max(names, key=won.get)
    return winner(model["families"][winner(list(model["families"]))])


def test_held_out(spark, sf):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op3_language_id(spark, sf).collect()
    held = [r.lang_pred == docs[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(docs) and sum(held) / len(held) > 0.95
