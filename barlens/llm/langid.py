"""Language by family first, then by linear support vector machines, one against one, within the family."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from barlens.llm.common import byte_slices, held_out, table, text_batches, written

#: Labelled texts per language that the machines are fitted on, at most about so many (picked by a hash of the id).
PER_LANG = 1500
#: Buckets for letter pairs and for letter triples (powers of two); iterations and regularisation of a machine.
BITS2, BITS3 = 10, 12
ITERATIONS, REGULARISATION = 12, 1e-3
#: Families by ISO 639-1 code.  A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv", "celtic": "br cy ga gd", "indo-aryan": "bn gu hi mr ne pa si ur", "iranian": "fa ku ps tg",
    "semitic": "am ar he mt", "turkic": "az kk ky tk tr tt ug uz", "uralic": "et fi hu", "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
}
UNKNOWN = "und"
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
BLOCK = 1 << 20


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].split("_")[0].lower(), lang)


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> 2 for a letter, 1 for a mark on one, else 0."""
    if not _LETTER:
        import unicodedata
        kind = {"L": 2, "M": 1}
        _LETTER.append(np.fromiter((kind.get(unicodedata.category(chr(i))[0], 0) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1))
    return _LETTER[0]


N_FEATURES = (1 << BITS2) + (1 << BITS3)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of root counts of hashed letter pairs and triples, words set off by blanks; None without a letter.

    Long texts are counted block by block; a block begins with the last two letters of the one before.
    """
    if not text:
        return None
    counts, tail, some = np.zeros(N_FEATURES), np.array([32], np.uint32), False
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[at:at + BLOCK].lower().encode("utf-32-le", "replace"), "<u4")
        letter = _letters()[c]
        some = some or bool((letter == 2).any())
        c = np.concatenate([tail, np.where(letter > 0, c, 32).astype(np.uint32)])
        gap = (c[1:] == 32) & (c[:-1] == 32)
        c = c[np.concatenate([[True], ~gap])]
        counts += _counted(c, len(tail))
        tail = c[-2:]
    if not some:
        return None
    if tail[-1] != 32:
        counts += _counted(np.append(tail, np.uint32(32)), len(tail))
    counts = np.sqrt(counts)
    return counts / np.sqrt((counts ** 2).sum())


def _counted(c: np.ndarray, old: int) -> np.ndarray:
    """Counts of the pairs and triples that end after the first ``old`` letters."""
    a = c * np.uint32(2654435761)
    pairs = (a[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    two = np.bincount(pairs[max(0, old - 1):] >> np.uint32(32 - BITS2), minlength=1 << BITS2)
    if len(c) < 3:
        return np.concatenate([two, np.zeros(1 << BITS3)])
    triples = (pairs[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
    return np.concatenate([two, np.bincount(triples[max(0, old - 2):] >> np.uint32(32 - BITS3), minlength=1 << BITS3)])


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, x.tolist()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (x := features(text)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["lang", "x"])


def _machine(train: DataFrame, label) -> tuple[np.ndarray, float]:
    svc = LinearSVC(maxIter=ITERATIONS, regParam=REGULARISATION, standardization=False, featuresCol="v", labelCol="y")
    m = svc.fit(train.select("v", label.cast("double").alias("y")))
    return m.coefficients.toArray(), m.intercept


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> dict:
    """Families, languages and machines from (doc_id, text, lang) of the texts that may be learned from.

    {"families": {family: [languages]}, "machines": [(kind, a, b)], "weights": matrix, "bias": vector}; a positive margin speaks for a.
    """
    text_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return {"families": {}, "machines": [], "weights": np.zeros((N_FEATURES, 0)), "bias": np.zeros(0)}
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1_000_000, int(per_lang / n * 1_000_000) + 1))])
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) < share[F.col("lang")])
    train = written(picked.select("lang", "text").mapInArrow(_training, "lang string, x array<float>"), "lang-train")
    langs = sorted(r.lang for r in train.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    train = train.select("lang", array_to_vector(F.col("x")).alias("v")).cache()
    machines, fitted = [], []
    names = sorted(families)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            two = train.where(F.col("lang").isin(families[a] + families[b]))
            machines.append(("family", a, b))
            fitted.append(_machine(two, F.col("lang").isin(families[a])))
    for name in names:
        for i, a in enumerate(families[name]):
            for b in families[name][i + 1:]:
                machines.append(("lang", a, b))
                fitted.append(_machine(train.where(F.col("lang").isin(a, b)), F.col("lang") == a))
    train.unpersist()
    weights = np.column_stack([w for w, _ in fitted]) if fitted else np.zeros((N_FEATURES, 0))
    return {"families": families, "machines": machines, "weights": weights, "bias": np.array([b for _, b in fitted])}


def _winner(names: list[str], margin: dict) -> tuple[str, float]:
    """Most duels won, then the largest sum of margins; with the mean confidence of its duels."""
    if len(names) == 1:
        return names[0], 1.0
    best = max(names, key=lambda a: (sum(margin[a, b] > 0 for b in names if b != a), sum(margin[a, b] for b in names if b != a), a))
    return best, float(np.mean([1 / (1 + np.exp(-2 * np.clip(margin[best, b], -20, 20))) for b in names if b != best]))


def _predicted(model: dict):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families, machines = model["families"], model["machines"]
        for batch in batches:
            for part in byte_slices(batch, 1):
                out = []
                for text in part.column(1).to_pylist():
                    x = features(text) if families else None
                    if x is None:
                        out.append((UNKNOWN, 0.0, None))
                        continue
                    margin = {}
                    for (_, a, b), m in zip(machines, x @ model["weights"] + model["bias"]):
                        margin[a, b], margin[b, a] = m, -m
                    family, p = _winner(sorted(families), margin)
                    lang, q = _winner(families[family], margin)
                    out.append((lang, p * q, family))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]],
                                                 names=["doc_id", "lang_pred", "score", "family"])
    return predicted


def predictions(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score, family per row of (doc_id, text); one pass, no shuffle.

    Texts that are null or have no letter, and all texts where nothing could be learned, are ``und`` with score 0; repeated rows
    are predicted each; a null id is not held out; an empty table gives no rows; other columns are no inputs.
    """
    text_batches(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _predicted(model), "doc_id long, lang_pred string, score double, family string")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "family")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predictions(docs, learn(docs))
