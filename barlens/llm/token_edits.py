"""Token counts that follow edits: a tree of pre-token counts per text, re-encoded only where an edit touches it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlens.llm.bpe import Bpe, default_tokenizer, loaded
from barlens.llm.common import byte_slices, table, text_batches

#: Fragments below a leaf of the tree.
LEAF = 32
TREES = "doc_id long, text string, n_tokens long, chars array<int>, tokens array<int>"


def counted(bpe: Bpe, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each fragment of a text."""
    found = bpe.fragments(text)
    ids = bpe.encode if any(t in text for t in bpe.added) else bpe.fragment_ids
    memo = bpe.memo.get
    if ids is bpe.encode:
        sizes = [len(ids(f)) for f in found]
    else:
        sizes = [len(memo(f) or ids(f)) for f in found]
    return np.fromiter(map(len, found), np.int32, len(found)), np.array(sizes, dtype=np.int32) // 4


class CountTree:
    """Sums of characters and tokens over the fragments of a text.

    A fragment is white space with the pre-tokens up to the next: no merge and no pre-token crosses its ends, so its count does not
    depend on what stands around it.  Leaves hold some fragments each; the nodes above, in heap order, hold the sums of
    their two children.  An edit replaces the fragments of a few neighbouring leaves and renews the sums on their paths; the text
    and the counts of all other leaves stay where they were.
    """

    def __init__(self, bpe: Bpe, text: str, chars: np.ndarray | None = None, tokens: np.ndarray | None = None):
        self.bpe, self.encoded, self.base = bpe, 0, text
        if chars is None:
            chars, tokens = counted(bpe, text)
            self.encoded = len(text)
        self.base_chars, self.base_tokens = chars, tokens
        self.n_leaves = max(1, -(-len(chars) // LEAF))
        self.size = 1 << max(0, self.n_leaves - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        if len(chars):
            at = np.arange(0, len(chars), LEAF)
            self.sums[self.size:self.size + len(at)] = np.column_stack([np.add.reduceat(chars, at), np.add.reduceat(tokens, at)])
        self.begins = np.concatenate([[0], np.cumsum(self.sums[self.size:self.size + self.n_leaves, 0])])  # in the text as it was
        lo = self.size
        while lo > 1:
            self.sums[lo // 2:lo] = self.sums[lo:2 * lo].reshape(-1, 2, 2).sum(axis=1)
            lo //= 2
        self.edited: dict[int, tuple[str, np.ndarray, np.ndarray]] = {}

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def _leaf(self, at: int) -> tuple[int, int]:
        """Leaf that holds a character, and where the leaf begins: down from the root by sums."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if at - begin >= self.sums[i, 0] and self.sums[i + 1, 0] > 0:
                begin += int(self.sums[i, 0])
                i += 1
        return i - self.size, begin

    def _held(self, leaf: int) -> tuple[str, np.ndarray, np.ndarray]:
        """Text, characters and tokens of a leaf."""
        if leaf in self.edited:
            return self.edited[leaf]
        i = leaf * LEAF
        return self.base[self.begins[leaf]:self.begins[leaf + 1]], self.base_chars[i:i + LEAF], self.base_tokens[i:i + LEAF]

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end (clamped to the text) by ``new``."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        # boundary context: the fragment of the character before, and that of the character after
        first, begin = self._leaf(max(0, start - 1))
        last, _ = self._leaf(min(end, max(0, self.n_chars - 1)))
        held = [self._held(leaf) for leaf in range(first, last + 1)]
        text, chars, tokens = "".join(h[0] for h in held), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        a, b = start - begin, end - begin
        ends = np.cumsum(chars)
        i = int(np.searchsorted(ends, a - 1, "right"))  # the first fragment that reaches beyond the character before
        j = min(len(chars), int(np.searchsorted(ends, b, "right")) + 1)
        pos, stop = int(ends[i - 1]) if i else 0, int(ends[j - 1]) if j else 0
        middle = text[pos:a] + new + text[b:stop]
        self.encoded += len(middle)
        new_chars, new_tokens = counted(self.bpe, middle)
        chars, tokens = (np.concatenate([old[:i], put, old[j:]]) for old, put in ((chars, new_chars), (tokens, new_tokens)))
        text = text[:pos] + middle + text[stop:]
        # the touched leaves share what they hold now; only their paths are renewed
        share, at, done = -(-len(chars) // (last - first + 1)), 0, 0
        for leaf in range(first, last + 1):
            c, t = chars[done:done + share], tokens[done:done + share]
            n = int(c.sum())
            self.edited[leaf] = (text[at:at + n], c, t)
            self.sums[self.size + leaf] = (n, t.sum())
            at, done = at + n, done + share
        i, j = (self.size + first) >> 1, (self.size + last) >> 1
        while i:
            self.sums[i:j + 1] = self.sums[2 * i:2 * j + 2].reshape(-1, 2, 2).sum(axis=1)
            i, j = i >> 1, j >> 1

    def state(self) -> tuple[str, np.ndarray, np.ndarray]:
        """Text, characters and tokens of all fragments."""
        if not self.edited:
            return self.base, self.base_chars, self.base_tokens
        parts, done = [], 0
        for leaf in sorted(self.edited):
            if leaf > done:
                parts.append((self.base[self.begins[done]:self.begins[leaf]], self.base_chars[done * LEAF:leaf * LEAF], self.base_tokens[done * LEAF:leaf * LEAF]))
            parts.append(self.edited[leaf])
            done = leaf + 1
        parts.append((self.base[self.begins[done]:] if done < self.n_leaves else "", self.base_chars[done * LEAF:], self.base_tokens[done * LEAF:]))
        return "".join(p[0] for p in parts), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

    def text(self) -> str:
        return self.state()[0]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    off = np.zeros(len(arrays) + 1, np.int32)
    off[1:] = np.cumsum([len(x) for x in arrays])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(arrays).astype(np.int32)))


def _trees(bpe_text, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = loaded(bpe_text.value)
    for batch in batches:
        for part in byte_slices(batch, 1):
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = [counted(bpe, t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.string()), pa.array([int(t.sum()) for _, t in found], pa.int64()), _lists([c for c, _ in found]), _lists([t for _, t in found])],
                names=["doc_id", "text", "n_tokens", "chars", "tokens"])


def count_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The kept state, one row per row of (doc_id, text): text, n_tokens, and the leaves of its tree (characters and tokens of each fragment).

    Null text counts as empty and has no leaves; repeated rows get a tree each; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda b: _trees(sent, b), TREES)


def edited(trees: DataFrame, tokenizer: str | None = None, state: bool = True) -> DataFrame:
    """Apply edits to trees: rows of count_trees with a column ``edits``, an array of (start, stop, new) in characters, in order.

    Each edit speaks of the text as the edits before have left it; positions are clamped to the text, null ``new`` deletes.
    Returns what it took, doc_id, n_before, n_after, chars_after, reencoded (characters encoded again), and with ``state`` the new
    state: text, n_tokens, chars, tokens.  Null edits leave a text as it is.
    """
    text_batches(trees.sparkSession)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        sent = trees.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "text", "n_tokens", "chars", "tokens", "edits"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        for batch in batches:
            for part in byte_slices(batch, 1):
                done = []
                for text, chars, tokens, edits in zip(part.column(1).to_pylist(), part.column(3), part.column(4), part.column(5).to_pylist()):
                    tree = CountTree(bpe, text, chars.values.to_numpy(), tokens.values.to_numpy())
                    for e in edits or []:
                        tree.replace(e["start"], e["stop"], e["new"] or "")
                    done.append(tree)
                out = {"doc_id": part.column(0), "n_before": part.column(2)}
                out |= {n: pa.array(v, pa.int64()) for n, v in (("n_after", [t.n_tokens for t in done]), ("chars_after", [t.n_chars for t in done]), ("reencoded", [t.encoded for t in done]))}
                if state:
                    new = [t.state() for t in done]
                    out |= {"text": pa.array([x for x, _, _ in new], pa.string()), "n_tokens": out["n_after"], "chars": _lists([c for _, c, _ in new]), "tokens": _lists([t for _, _, t in new])}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
    schema = "doc_id long, n_before long, n_after long, chars_after long, reencoded long" + (", text string, n_tokens long, chars array<int>, tokens array<int>" if state else "")
    return trees.select(*names).mapInArrow(apply, schema)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds the edits (doc_id, nr, start, stop, new) of each document, in the order of nr, to its tree."""
    each = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nr", "start", "stop", "new"))).alias("_e"))
    each = each.select("doc_id", F.transform("_e", lambda e: F.struct(e["start"].cast("int").alias("start"), e["stop"].cast("int").alias("stop"), e["new"].alias("new"))).alias("edits"))
    return trees.join(each, "doc_id", "left")


def derived_edits(text):
    """Three edits made from a text itself: cut some characters after a third, repeat the beginning in the middle, shout after a quarter."""
    n = F.length(text)
    edit = lambda a, b, new: F.struct(F.floor(a).cast("int").alias("start"), F.floor(b).cast("int").alias("stop"), new.alias("new"))
    return F.array(edit(n / 3, n / 3 + 7, F.lit("")), edit(n / 2, n / 2, F.substring(text, 1, 24)),
                   edit(n / 4, n / 4 + 40, F.upper(F.expr("substring(text, cast(floor(length(text) / 4) as int) + 1, 40)"))))


def op5_token_edits(spark, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits that are derived from its text."""
    trees = count_trees(table(spark, sf_dir, "documents"))
    return edited(trees.withColumn("edits", derived_edits(F.col("text"))), state=False)
