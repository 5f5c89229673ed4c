"""Toxicity from a lexicon: a trie met by Levenshtein automata, and scores from the words around a hit."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barlens.llm.common import byte_slices, held_out, table, text_batches, written

#: Labelled rows that the lexicon and its weights are learned from, at most about so many (picked by a hash of the id).
TRAIN_ROWS = 40_000
#: An entry occurs in so many families of toxic texts at least, in this share of them, and so many times as often as in other texts.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 3, 0.015, 12
#: A kind of hit (entry and edits) counts if it is abuse in this share of the training texts that have it.
LEAST_PRECISION = 0.6
#: A stem has from 4 to 8 letters and so many different words; a lexicon has at most so many entries.
STEM, STEM_WORDS = (4, 8), 3
THRESHOLD = 0.3
#: Words on each side of a hit that are its context.
WINDOW = 8
#: Words that report speech and words that address somebody.
REPORTS = {"said", "says", "wrote", "quote", "quoted", "quotes", "called", "reported", "term", "word", "phrase",
           "sagte", "schrieb", "zitat", "wort", "dit", "écrit", "citation", "mot", "dijo", "escribió", "cita", "palabra"}
ADDRESS = {"you", "your", "youre", "ur", "du", "dein", "deine", "ihr", "tu", "toi", "vous", "ton", "usted", "tú", "eres"}
QUOTES = "\"“”„«»‘’"
#: What a hit is taken to count by its context before labelled texts are seen, and how many hits this belief weighs.
CONTEXT, CONTEXT_BELIEF = {"quoted": 0.25, "reported": 0.6, "plain": 1.0, "direct": 1.1}, 20.0
#: Precision that a hit with so many edits is taken to have before counts are seen, and the weight of that belief.
PRIOR, BELIEF = (0.9, 0.35, 0.2), 4.0
TOKEN = re.compile(r"[^\W_]+|[" + QUOTES + r"]")


def allowed_edits(entry: str) -> int:
    """Edits that a misspelling of an entry may have; ``*`` at the end marks a stem."""
    n = len(entry.rstrip("*"))
    if entry.endswith("*"):
        return 1 if n >= 7 else 0
    return 0 if n < 5 else 1 if n < 9 else 2


class Matcher:
    """Entries within their allowed edit distance of a word.

    The trie of the entries with k edits is run together with the Levenshtein automaton of the word: a state is a trie node with
    the edits that are left.  Sets of states are numbered and their transitions kept, so a deterministic automaton
    grows as words need it.  A word whose first letters lead to the empty set is dead.
    """

    MOST = 200_000

    def __init__(self, entries: list[str]):
        self.children: list[dict[str, int]] = []
        self.word: list[int] = []
        self.stem: list[int] = []
        self.entries, self.edits = entries, [allowed_edits(e) for e in entries]
        roots = {}
        for i, e in enumerate(entries):
            k = self.edits[i]
            if k not in roots:
                roots[k] = self._node()
            node = roots[k]
            for ch in e.rstrip("*"):
                if ch not in self.children[node]:
                    self.children[node][ch] = self._node()
                node = self.children[node][ch]
            (self.stem if e.endswith("*") else self.word)[node] = i
        self.begin = [(r, k) for k, r in roots.items()]
        self._reset()

    def _node(self) -> int:
        self.children.append({})
        self.word.append(-1)
        self.stem.append(-1)
        return len(self.children) - 1

    def _reset(self) -> None:
        self.sets, self.numbers, self.steps, self.found, self.alive = [], {}, {}, {}, {}
        self.start = self._number(self._closed(self.begin))

    def _closed(self, states) -> frozenset:
        """With the states that come by leaving out letters of an entry; of a node, the most edits left count."""
        left, todo = {}, list(states)
        while todo:
            node, e = todo.pop()
            if left.get(node, -1) >= e:
                continue
            left[node] = e
            if e:
                todo += [(c, e - 1) for c in self.children[node].values()]
        return frozenset(left.items())

    def _number(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
        return self.numbers[states]

    def _step(self, state: int, ch: str) -> int:
        key = (state, ch)
        if key not in self.steps:
            out = []
            for node, e in self.sets[state]:
                child = self.children[node].get(ch)
                if child is not None:
                    out.append((child, e))
                if e:
                    out.append((node, e - 1))
                    out += [(c, e - 1) for c in self.children[node].values()]
            self.steps[key] = self._number(self._closed(out))
        return self.steps[key]

    def _best(self, state: int, ends: list[int]) -> tuple[int, int] | None:
        hits = [(self.edits[ends[n]] - e, ends[n]) for n, e in self.sets[state] if ends[n] >= 0]
        return min(hits) if hits else None

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry, or None."""
        head = word[:4]
        live = self.alive.get(head)
        if live is None:
            state, live = self.start, False
            for ch in head:
                state = self._step(state, ch)
                live = live or self._best(state, self.stem) is not None
            live = self.alive[head] = live or bool(self.sets[state])
        if not live:
            return None
        if word in self.found:
            return self.found[word]
        if len(self.found) > self.MOST or len(self.steps) > self.MOST or len(self.alive) > self.MOST:
            self._reset()
        state, stem = self.start, None
        for ch in word:
            state = self._step(state, ch)
            if not self.sets[state]:
                break
            if (s := self._best(state, self.stem)) and (stem is None or s < stem):
                stem = s
        whole = self._best(state, self.word) if self.sets[state] else None
        best = min((x for x in (stem, whole) if x), default=None)
        self.found[word] = best
        return best

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """(entry, edits, context) of every hit in a text."""
        tokens = TOKEN.findall(text.lower())
        match = self.match
        bad = {w: m for w in set(tokens) if (m := match(w))}
        if not bad:
            return []
        out = []
        for i, w in enumerate(tokens):
            if w in bad:
                before, after = tokens[max(0, i - WINDOW):i], tokens[i + 1:i + 1 + WINDOW]
                quotes = sum(t in QUOTES for t in before)
                if quotes % 2 and any(t in QUOTES for t in after):
                    context = "quoted"
                elif not ADDRESS.isdisjoint(before) or not ADDRESS.isdisjoint(after) or any(t in bad for t in before) or any(t in bad for t in after):
                    context = "direct"
                elif not REPORTS.isdisjoint(before):
                    context = "reported"
                else:
                    context = "plain"
                out.append((bad[w][1], bad[w][0], context))
        return out


def _score(hits, weight, base: float, contexts: dict | None = None) -> float:
    """Chance that at least one hit is abuse; the strongest context of an entry counts once."""
    best, contexts = {}, contexts or CONTEXT
    for entry, edits, context in hits:
        w = min(0.995, weight.get((entry, edits), PRIOR[edits]) * contexts[context])
        key = (entry, context == "quoted")
        best[key] = max(best.get(key, 0.0), w)
    clean = 1.0 - base
    for w in best.values():
        clean *= 1.0 - w
    return 1.0 - clean


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(entries: tuple) -> Matcher:
    if entries not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[entries] = Matcher(list(entries))
    return _MATCHERS[entries]


def _training_hits(entries: tuple):
    """Per training text, each (entry, edits, context) it has, context '' for any outside quotations, and (-1, 0, '') if it has none there."""
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(entries)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(m.hits(text or ""))
                outside = {(e, d, "") for e, d, c in found if c != "quoted"} or {(-1, 0, "")}
                rows += [(*h, toxic) for h in sorted(found | outside)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 2 else pa.int32()) for i in range(4)],
                                             names=["entry", "edits", "context", "toxic"])
    return hits


def _scored(model: dict, threshold: float):
    entries = model["entries"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(entries)
        for batch in batches:
            for part in byte_slices(batch, 1):
                found = [m.hits(t) if t else [] for t in part.column(1).to_pylist()]
                scores = [_score(h, model["weight"], model["base"], model["context"]) for h in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                     pa.array([len(h) for h in found], pa.int32())], names=["doc_id", "score", "predicted", "n_hits"])
    return scored


def for_training(doc_id: Column) -> Column:
    """Rows that labels may be learned from."""
    return ~held_out(doc_id, 4, 2) & doc_id.isNotNull()


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Lexicon and weights from labelled texts: {"entries", "weight", "base", "context"}.

    A label other than 0 and 1 is no label; a document with both is toxic.

    Words are counted by families of toxic texts and by other texts that have them; stems are prefixes shared by several such
    words.  An entry has more support than chance gives to any word, and a minimum precision.  The matcher then runs over the same texts, so a misspelling that mostly occurs in other texts gets a
    small weight.  What a context is worth is learned likewise: how many hits in it lie in toxic texts, against how many their entries'
    precision makes one expect.  Without toxic labels the lexicon is empty.  It grows with the words of the bounded sample.
    """
    text_batches(docs.sparkSession)
    known = labels.where(for_training(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # the bounded sample is small enough to send: two numbers a row
    train = docs.where(for_training(F.col("doc_id"))).select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # near copies of one text are a family: they share the word that comes first in hash order, mostly
    letters = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    hashes = F.transform(F.filter("words", lambda w: F.length(w) >= 6), lambda w: F.xxhash64(w))
    family = F.coalesce(F.array_min(hashes), F.xxhash64(F.coalesce("text", F.lit(""))))
    train = written(train.select("text", "toxic", letters.alias("words")).withColumn("family", family), "toxic-train")
    n = train.groupBy("toxic").agg(F.count("*").alias("n"), F.count_distinct("family").alias("families")).collect()
    n = {r.toxic: r for r in n}
    pos, neg = (n[1].families if 1 in n else 0), (n[0].n if 0 in n else 0)
    if not pos:
        return {"entries": (), "weight": {}, "base": 1.0 / (neg + 20.0), "context": dict(CONTEXT)}
    words = train.select("toxic", "family", F.explode(F.array_distinct("words")).alias("word"))
    words = words.groupBy("word").agg(F.collect_set(F.when(F.col("toxic") == 1, F.col("family"))).alias("families"), F.sum(1 - F.col("toxic")).alias("neg"))
    words = written(words.withColumn("pos", F.size("families")), "toxic-words")
    least = max(LEAST_TEXTS, LEAST_SHARE * pos)

    def fit(df, n_terms):
        # by chance no more than one term would be in so many toxic families; and its rate there is a multiple of that elsewhere
        chance = math.log(max(2, n_terms)) / -math.log(min(0.9, pos / (pos + neg)))
        odds = ((F.col("pos") + 0.5) / (pos + 1)) / ((F.col("neg") + 0.5) / (neg + 1))
        return df.where((F.col("pos") >= max(least, chance)) & (odds >= LEAST_ODDS))
    n_words = words.count()
    parts = F.expr(f"transform(sequence({STEM[0]}, least({STEM[1]}, length(word) - 1)), n -> substring(word, 1, n))")
    longer = words.where(F.length("word") > STEM[0]).withColumn("stem", F.explode(parts))
    stems = longer.where("pos > 0").select("stem", "word", "pos", F.explode("families").alias("family")).groupBy("stem").agg(
        F.count_distinct("family").alias("pos_all"), F.count_distinct("word").alias("n"), F.max("pos").alias("top")).withColumnRenamed("pos_all", "pos")
    stems = stems.join(longer.groupBy("stem").agg(F.sum("neg").alias("neg")), "stem")
    stems = fit(stems, n_words).where((F.col("n") >= STEM_WORDS) & (F.col("top") < 0.8 * F.col("pos")))
    top_words = [r.word for r in fit(words.where(F.length("word") >= 3), n_words).select("word").collect()]
    top_stems = {r.stem: r.pos for r in stems.select("stem", "pos").collect()}

    def shorter(s: str) -> list[str]:
        return [s[:n] for n in range(STEM[0], len(s))]
    # of nested stems the longest that keeps nearly all texts of the shorter
    beaten = {t for s, n in top_stems.items() for t in shorter(s) if t in top_stems and n >= 0.95 * top_stems[t]}
    chosen = set(top_stems) - beaten
    chosen = {s for s in chosen if not any(t in chosen for t in shorter(s))}
    entries = tuple([s + "*" for s in sorted(chosen)] + [w for w in sorted(top_words) if w not in chosen and not any(t in chosen for t in shorter(w))])
    seen = train.select("text", "toxic").mapInArrow(_training_hits(entries), "entry int, edits int, context string, toxic int") \
        .groupBy("entry", "edits", "context", "toxic").count().collect()
    counts = {}
    for r in seen:
        if r.context == "":
            counts.setdefault((r.entry, r.edits), [0, 0])[r.toxic] += r["count"]
    weight = {}
    for (e, d), (no, yes) in counts.items():
        if e >= 0:
            w = (yes + BELIEF * PRIOR[d]) / (yes + no + BELIEF)
            weight[e, d] = w if w >= LEAST_PRECISION else 0.0
    none = counts.get((-1, 0), [0, 0])
    context = {}
    for name, before in CONTEXT.items():
        hits = [(weight.get((r.entry, r.edits), 0.0), r["count"], r.toxic) for r in seen if r.context == name]
        toxic = sum(n for w, n, t in hits if t and w > 0)
        expected = sum(w * n for w, n, _ in hits)
        context[name] = min(1.2, (toxic + CONTEXT_BELIEF * before) / (expected + CONTEXT_BELIEF))
    return {"entries": entries, "weight": weight, "base": min(0.2, (none[1] + 0.5) / (sum(none) + 20.0)), "context": context}


def scores(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits per row of (doc_id, text); one pass, no shuffle.

    Null and empty texts have no hits and get the base score; repeated rows are scored each; a null id is never held out; an
    empty table gives no rows; other columns are not read, in particular labels, lang and source are no inputs.
    """
    text_batches(docs.sparkSession)
    fn = _scored(model, threshold)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        fn, "doc_id long, score double, predicted int, n_hits int")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted", "n_hits")


def without_toxic(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns, in one pass."""
    model = learn(train_docs, labels)
    text_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(model["entries"])
        for batch in batches:
            keep = [_score(m.hits(t) if t else [], model["weight"], model["base"], model["context"]) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(clean, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, learn(docs, table(spark, sf_dir, "labels")))
