"""Word shingles of whole texts as 64-bit values, computed on the bytes of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(int(_BASE), -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = [np.ones(1, U), np.ones(1, U)]
BLOCK = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            p = np.full(n, base, U)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes and the position each begins at; a word ends at white space or at a break.

    A word's hash is a polynomial of its bytes, read off prefix sums modulo 2**64.
    """
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    at = breaks[(breaks > 0) & (breaks < len(data))]
    begins[at] = word[at]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[at - 1] = word[at - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    return mixed((sums[e] - sums[s]) * down[s]), s


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Borders of blocks of a long text that end at white space."""
    a = 0
    while a < len(data):
        b = min(len(data), a + BLOCK)
        while b < len(data) and not (gaps := np.flatnonzero(_SPACE[data[max(a, b - BLOCK):b]])).size:
            b = min(len(data), b + BLOCK)
        if b < len(data):
            b = max(a, b - BLOCK) + int(gaps[-1]) + 1
        yield a, b
        a = b


def _sums(words: np.ndarray, k: int) -> np.ndarray:
    if len(words) < k:
        return np.zeros(0, U)
    out = np.zeros(len(words) - k + 1, U)
    for i in range(k):
        out += words[i:len(words) - k + 1 + i] * _PLACE[i]
    return mixed(out)


def _set(words: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    if len(words) >= k:
        return np.unique(sums)
    if len(words):
        return mixed(np.array([(words * _PLACE[:len(words)]).sum() + U(len(words))], U))
    return np.zeros(0, U)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct values of its k-word shingles; with fewer words, of the whole sequence; null is empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_string_view(texts.type):
        texts = texts.cast(pa.string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if len(data) > BLOCK and len(texts) == 1:
        words = np.concatenate([_word_hashes(data[a:b], np.zeros(0, np.int64))[0] for a, b in _blocks(data)])
        yield _set(words, _sums(words, k), k)
        return
    words, starts = _word_hashes(data, offsets)
    sums, cuts = _sums(words, k), np.searchsorted(starts, offsets)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield _set(words[a:b], sums[a:max(a, b - k + 1)], k)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of values."""
    both = (tokens.sum(dtype=U), mixed(tokens ^ _BASE).sum(dtype=U))
    return tuple(int(mixed(np.array([x + U(len(tokens))], U)).view(np.int64)[0]) for x in both)


def least(tokens: np.ndarray, keys: int) -> list[int]:
    """Smallest values under ``keys`` random orders: equal for two sets with a chance of their Jaccard similarity each."""
    return [int(mixed(tokens ^ _PLACE[32 + i]).min().view(np.int64)) for i in range(keys)]
