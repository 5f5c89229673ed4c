"""Random choices that every task can work out for its own rows: keyed permutations and draws with replacement.

All randomness is a hash of a seed, the number of the resample and the place, in 32-bit arithmetic that SQL can repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
M32 = U(0xFFFFFFFF)
# fixed values: odd multipliers of a 32-bit mixing step
MIX_1, MIX_2 = 2654435761, 2246822519
ROUNDS = 4


def mixed(*parts) -> np.ndarray:
    """32 bits from whole numbers (scalars or arrays)."""
    h = U(0)
    for v in parts:
        h = ((h ^ (np.asarray(v).astype(U) & M32)) * U(MIX_1)) & M32
        h = h ^ (h >> U(15))
        h = (h * U(MIX_2)) & M32
        h = h ^ (h >> U(13))
    return h


def half_bits(size: int) -> int:
    """Bits of one half of the numbers that a permutation of 0 .. size - 1 works on."""
    return max((max(size - 1, 1).bit_length() + 1) // 2, 1)


def permuted(k: np.ndarray, size: int, seed: int, which: int) -> np.ndarray:
    """Numbers below ``size`` under the permutation number ``which``: a Feistel network, walked until the number is below size again."""
    bits = half_bits(size)
    mask, out = U((1 << bits) - 1), k.astype(U)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> U(bits), x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mixed(seed, which, r, right) & mask)
        out[todo] = (left << U(bits)) | right
        todo = todo[out[todo] >= U(size)]
    return out.astype(np.int64)


class _Binomial:
    """Quantiles of binomial counts: the least x whose distribution function reaches u."""

    def __init__(self, most: int):
        self.log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])

    def __call__(self, n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
        sd = np.sqrt(n * p * (1 - p))
        lo = np.maximum(np.floor(n * p - 12 * sd - 10), 0).astype(np.int64)
        width = int(np.ceil(24 * sd.max(initial=0.0) + 22))
        x = lo[:, None] + np.arange(width)
        inside = x <= n[:, None]
        y = np.where(inside, x, 0)
        f = self.log_fact
        log_p = f[n][:, None] - f[y] - f[n[:, None] - y] + y * np.log(p) + (n[:, None] - y) * np.log1p(-p)
        cdf = np.cumsum(np.where(inside, np.exp(log_p), 0.0), axis=1)
        below = (cdf < u[:, None]) & inside
        return np.minimum(lo + below.sum(axis=1), n)


def times_drawn(wanted: np.ndarray, size: int, resamples: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each wanted place (sorted, below ``size``): its index and how often each resample of ``size`` draws takes it.

    The draws are split at the middle of a stretch of places, the left part being binomial with a uniform number hashed from resample
    and stretch, and so on down; only stretches with wanted places are visited.
    """
    quantile, which = _Binomial(size), np.arange(resamples)
    stack = [(0, size, np.full(resamples, size, dtype=np.int64), 0, len(wanted))]
    while stack:
        lo, hi, n, a, b = stack.pop()
        if a == b:
            continue
        if hi - lo == 1:
            for i in range(a, b):
                yield i, n
            continue
        mid = (lo + hi) // 2
        u = (mixed(seed, which, lo, hi).astype(np.float64) + 0.5) / 4294967296.0
        left = quantile(n, (mid - lo) / (hi - lo), u)
        cut = a + int(np.searchsorted(wanted[a:b], mid))
        stack += [(mid, hi, n - left, cut, b), (lo, mid, left, a, cut)]


__all__ = ["mixed", "half_bits", "permuted", "times_drawn", "MIX_1", "MIX_2", "ROUNDS"]
