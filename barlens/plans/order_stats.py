"""Order statistics of moving windows in one pass over a block.

A block's values become ranks in a wavelet matrix: one array of running counts for each bit of the rank.  How many values of
any stretch of rows lie below a value, and which value stands at a place of the sorted stretch, are then read off with one
step for each bit, for all rows at once.  So a row costs the logarithm of the block's size, however long its window is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T


class Ranks:
    """Values without gaps, ready for questions about stretches [lo, hi)."""

    def __init__(self, values: np.ndarray):
        self.values, rank = np.unique(values, return_inverse=True)
        self.rank = rank.astype(np.int64)
        self.bits = max(int(len(self.values) - 1).bit_length(), 1)
        self.zeros, self.border = [], []
        x = self.rank
        for b in range(self.bits - 1, -1, -1):
            one = (x >> b) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            self.border.append(int(len(x) - one.sum()))
            x = np.concatenate([x[~one], x[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many values of each stretch have a smaller rank."""
        whole = rank >= 1 << self.bits
        out, size = np.zeros(len(lo), np.int64), hi - lo
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            zeros, border = self.zeros[level], self.border[level]
            zl, zh, one = zeros[lo], zeros[hi], (rank >> b) & 1 == 1
            out += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, border + lo - zl, zl), np.where(one, border + hi - zh, zh)
        return np.where(whole, size, out)

    def at(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The value at a place of each sorted stretch, counted from 0; places outside give NaN."""
        fine = (place >= 0) & (place < hi - lo)
        lo, hi, k = np.where(fine, lo, 0), np.where(fine, hi, 0), np.where(fine, place, 0)
        rank = np.zeros(len(lo), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            zeros, border = self.zeros[level], self.border[level]
            zl, zh = zeros[lo], zeros[hi]
            one = k >= zh - zl
            rank |= np.where(one & fine, 1 << b, 0)
            k = np.where(one, k - (zh - zl), k)
            lo, hi = np.where(one, border + lo - zl, zl), np.where(one, border + hi - zh, zh)
        return np.where(fine, self.values[np.minimum(rank, len(self.values) - 1)], np.nan)


@dataclass(frozen=True)
class Moving:
    """A statistic of the last ``n`` values of a column, ``back`` rows behind the current one.

    kind: quantile (``p``, between neighbours in proportion), place (``p`` is the place in the sorted window), rank (of the
    current value, ties in the middle, as a share) or below (share of values smaller than the current one).  NULL is
    skipped; ``mp`` values are needed, and ``n + back`` rows of history if ``full``.
    """

    out: str
    column: str
    kind: str
    n: int
    p: float = 0.5
    mp: int = 1
    full: bool = True
    back: int = 0

    def __call__(self, x: np.ndarray, rn: np.ndarray, ranks: Ranks, seen: np.ndarray) -> np.ndarray:
        """``seen``: values without gaps before each row, one entry more than rows."""
        row = np.arange(len(x))
        stop = np.maximum(row + 1 - self.back, 0)
        lo, hi = seen[np.maximum(stop - self.n, 0)], seen[stop]
        size = hi - lo
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.kind == "quantile":
                place = np.maximum(size - 1, 0) * self.p
                left = np.floor(place).astype(np.int64)
                a, b = ranks.at(lo, hi, left), ranks.at(lo, hi, np.minimum(left + 1, size - 1))
                out = np.where(place > left, a + (b - a) * (place - left), a)
            elif self.kind == "place":
                out = ranks.at(lo, hi, np.full(len(x), int(self.p)))
            else:
                known = ~np.isnan(x)
                rank = np.searchsorted(ranks.values, np.where(known, x, 0.0))
                less = ranks.below(lo, hi, rank)
                if self.kind == "rank":
                    same = ranks.below(lo, hi, np.searchsorted(ranks.values, np.where(known, x, 0.0), side="right")) - less
                    out = (less + (same + 1) / 2.0) / size
                else:
                    out = less / size
                out = np.where(known, out, np.nan)
        ready = size >= max(min(self.mp, self.n), 1)
        if self.full:
            ready &= rn >= self.n + self.back - 1
        return np.where(ready, out, np.nan)


def _doubles(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).cast(pa.float64()).to_numpy().astype(np.float64)


def in_blocks(df: DataFrame, fields: Sequence[str], work: Callable[[pa.Table], Sequence[np.ndarray]], keys: Sequence[str] = ("symbol",),
              core_only: bool = False) -> DataFrame:
    """Add double columns that ``work`` makes of the ordered rows of each block; NaN becomes NULL.

    The grouping is that of the windows over a block, so no rows are moved for it.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(f, T.DoubleType()) for f in fields]])

    def one(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("rn").to_numpy(), kind="stable")))
        for name, made in zip(fields, work(t)):
            t = t.append_column(name, pa.array(made, pa.float64(), mask=np.isnan(made)))
        return t.filter(t.column("core")) if core_only else t

    return df.groupBy(*keys, "blk").applyInArrow(one, schema)


def moving(df: DataFrame, *stats: Moving, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add moving order statistics to a blocked table whose lookback covers their windows."""
    def work(t: pa.Table) -> list[np.ndarray]:
        rn, made = t.column("rn").to_numpy(), {}
        for name in {s.column for s in stats}:
            x = _doubles(t, name)
            known = ~np.isnan(x)
            made[name] = x, rn, Ranks(x[known]) if known.any() else Ranks(np.zeros(1)), np.concatenate([[0], np.cumsum(known)])
        return [s(*made[s.column]) for s in stats]

    return in_blocks(df, [s.out for s in stats], work, keys)


def windows_through(df: DataFrame, out: str, column: str, n: int, func: Callable[[np.ndarray], np.ndarray], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Any function of a window that is no Column expression: ``func`` gets all full windows of a block as rows of one array and
    returns a value for each.  The array is a view, so nothing is copied; rows with fewer than ``n`` rows of history or a
    gap in the window give NULL.
    """
    def work(t: pa.Table) -> list[np.ndarray]:
        x = _doubles(t, column)
        made = np.full(len(x), np.nan)
        if len(x) >= n:
            view = np.lib.stride_tricks.sliding_window_view(x, n)
            whole = ~np.isnan(view).any(axis=1)
            made[np.flatnonzero(whole) + n - 1] = func(view[whole])
        made[t.column("rn").to_numpy() < n - 1] = np.nan
        return [made]

    return in_blocks(df, [out], work, keys)


__all__ = ["Ranks", "Moving", "moving", "in_blocks", "windows_through"]
