"""Byte-pair encoding and decoding with forced boundaries."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barlens.llm.common import byte_slices, table, text_batches

#: The pre-token pattern of byte-level BPE files, and the characters that Unicode calls white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _alphabet() -> dict[str, int]:
    """Character in the file -> byte: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_NONE = 1 << 60


class Bpe:
    """Encoder and decoder of one tokenizer file.

    A text is cut where no merge can reach across: where a word ends and white space begins, and, inside pre-tokens, between
    two bytes that are never neighbours inside any vocabulary token.  The fragments are encoded independently, remembered up
    to ``memo`` of them, and concatenated.
    """

    def __init__(self, file_text: str, memo: int = 400_000):
        import regex
        spec = json.loads(file_text)
        byte_of = _alphabet()
        as_bytes = lambda t: bytes(byte_of[c] for c in t)
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.first = [vocab[bytes([b])] for b in range(256)]
        self.rank, self.merged = {}, []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            a, b = as_bytes(a), as_bytes(b)
            self.rank[vocab[a], vocab[b]] = rank
            self.merged.append(vocab[a + b])
        pieces = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.pieces = np.array([pieces.get(i, b"") for i in range(max(pieces) + 1)], dtype=object)
        inside = {pair for t in vocab for pair in zip(t, t[1:])}
        self.forced = {(a, b) for a in range(256) for b in range(256)} - inside
        self.pre_token = regex.compile(PRE_TOKEN)
        self.fragment = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.memo, self.older, self.most = {}, {}, memo

    def _merge(self, piece: bytes) -> list[int]:
        """Merge by rank, the leftmost first."""
        ids = [self.first[b] for b in piece]
        if len(ids) > 200:
            return self._merge_long(ids)
        rank, merged = self.rank.get, self.merged
        ranks = [rank(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < _NONE:
            i = ranks.index(r)
            ids[i] = merged[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for n bytes."""
        rank, merged, n = self.rank, self.merged, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _fragment(self, text: str) -> bytes:
        out, forced = [], self.forced
        word = text[1:] if text[0] == " " else text
        for m in (text,) if word.isalpha() else self.pre_token.findall(text):  # letters after at most one blank are one pre-token
            piece, at = m.encode(), 0
            for i in [i for i, pair in enumerate(zip(piece, piece[1:]), 1) if pair in forced]:
                out += self._merge(piece[at:i])
                at = i
            out += self._merge(piece[at:])
        return struct.pack(f"<{len(out)}I", *out)

    def fragments(self, text: str) -> list[str]:
        return self.fragment.findall(text)

    def fragment_ids(self, fragment: str) -> bytes:
        """Ids of one fragment, little-endian unsigned 32-bit.  Two generations of remembered fragments: what is used again stays."""
        ids = self.older.get(fragment)
        if ids is None:
            ids = self._fragment(fragment)
        if len(fragment) < 64:
            if len(self.memo) >= self.most:
                self.older, self.memo = self.memo, {}
            self.memo[fragment] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        new = self.fragment_ids
        return b"".join([self.memo.get(f) or new(f) for f in self.fragments(text)])

    def encode(self, text: str) -> bytes:
        if self.special is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(np.array([self.added[x]], dtype="<u4").tobytes() if x in self.added else self._plain(x) for x in self.special.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(self.pieces[np.frombuffer(ids, dtype="<u4")].tolist()).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(file_text: str) -> Bpe:
    """The encoder of a file, once per Python worker."""
    key = hashlib.sha256(file_text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(file_text)
    return _LOADED[key]


def with_ids(docs: DataFrame, tokenizer: str | None = None, decoded: bool = False) -> DataFrame:
    """Adds n_tokens, ids (array<int>) and, if asked for, the decoded text to (doc_id, text); one task per input split, no shuffle.

    The file is read by the driver and sent along (its size is that of a vocabulary).  Null text counts as empty and has no
    tokens; repeated rows are encoded each; an empty table gives no rows; only doc_id and text are read.
    """
    return _encode(docs, tokenizer, "doc_id long, n_tokens long, ids array<int>" + (", decoded string" if decoded else ""),
                   lambda bpe, ids: (len(ids) // 4, np.frombuffer(ids, dtype="<i4")) + ((bpe.decode(ids),) if decoded else ()))


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of (doc_id, text); see with_ids for the edge cases."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _encode(docs, tokenizer, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                   lambda bpe, ids: (len(ids) // 4, sha(ids), sha(bpe.decode(ids).encode())))


def _encode(docs: DataFrame, tokenizer: str | None, schema: str, row) -> DataFrame:
    spark = docs.sparkSession
    text_batches(spark)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    kinds = [kinds[c.split()[1]] for c in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        for batch in batches:
            for part in byte_slices(batch, 1, 8 << 20):
                out = [(doc, *row(bpe, bpe.encode(text or ""))) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(encode, schema)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
