"""First touches and extremes of the rows ahead, without a path per row.

A block's highs and lows go into sparse tables: the extreme of every stretch of 1, 2, 4, ... rows.  The first row that reaches
a level is found by halving: from the longest stretch down, a stretch is passed over if its extreme stays short of the level.
The extreme of any stretch is that of two overlapping ones.  A row costs the logarithm of the horizon.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barlens.plans.order_stats import _doubles, in_blocks


class Extremes:
    """Sparse table of the largest (or smallest) value of every stretch; missing values reach nothing."""

    def __init__(self, x: np.ndarray, largest: bool, most: int):
        self.sign = 1.0 if largest else -1.0
        x = self.sign * x
        self.levels = [np.where(np.isnan(x), -np.inf, x)]
        while 2 << (len(self.levels) - 1) <= min(most, len(x)):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def first(self, start: np.ndarray, stop: np.ndarray, level: np.ndarray) -> np.ndarray:
        """First place in [start, stop) that reaches the level, else stop; a missing level is never reached."""
        level = np.where(np.isnan(level), np.inf, self.sign * level)
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            width, top = 1 << k, self.levels[k]
            fits = at + width <= stop
            short = top[np.minimum(at, len(top) - 1)] < level
            at = np.where(fits & short, at + width, at)
        return at

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The extreme of [start, stop), NaN where it is empty or has no value."""
        size = stop - start
        k = np.maximum(np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1, 0)
        out = np.full(len(start), -np.inf)
        for level in np.unique(k[size > 0]):
            rows = np.flatnonzero((k == level) & (size > 0))
            top = self.levels[level]
            out[rows] = np.maximum(top[start[rows]], top[stop[rows] - (1 << int(level))])
        return np.where(np.isinf(out), np.nan, self.sign * out)


@dataclass(frozen=True)
class Touch:
    """Bars until ``side`` (high or low) of a bar ahead reaches the level in a column, from above or below as the side says."""

    out: str
    level: str
    side: str
    upward: bool


@dataclass(frozen=True)
class Excursion:
    """Best and worst prices ahead of an exit: over the bars before the exit bar, or all bars if nothing is touched.

    ``exits`` names the touches of stop, target and, if there is one, liquidation, which counts where the stop is not before it.
    ``best`` and ``worst`` say which side counts and whether its largest value does.  Adds out_best, out_best_at, out_worst, out_worst_at
    (bars from the entry's next one).
    """

    out: str
    exits: tuple[str, ...]
    best: tuple[str, bool]
    worst: tuple[str, bool]


def ahead(df: DataFrame, h: int, touches: Sequence[Touch], excursions: Sequence[Excursion] = (), keys: Sequence[str] = ("symbol",),
          bars: str = "_n", last: str = "_last") -> DataFrame:
    """Core rows of a blocked table (lookahead >= h) with what the next ``h`` bars do: number of bars, last close, touches, excursions."""
    fields = [bars, last, *[t.out for t in touches], *[f"{e.out}_{k}" for e in excursions for k in ("best", "best_at", "worst", "worst_at")]]

    def work(t: pa.Table) -> list[np.ndarray]:
        rows = np.flatnonzero(t.column("core").to_numpy())
        sides = {"high": _doubles(t, "high"), "low": _doubles(t, "low")}
        tables: dict[tuple[str, bool], Extremes] = {}

        def table(side: str, largest: bool) -> Extremes:
            if (side, largest) not in tables:
                tables[side, largest] = Extremes(sides[side], largest, h)
            return tables[side, largest]

        size, close = t.num_rows, _doubles(t, "close")
        start, stop = rows + 1, np.minimum(rows + 1 + h, size)
        made = {bars: stop - start + 0.0, last: np.where(stop > start, close[stop - 1], np.nan)}
        hits = {}
        for x in touches:
            hits[x.out] = at = table(x.side, x.upward).first(start, stop, _doubles(t, x.level)[rows])
            made[x.out] = np.where(at < stop, at - rows, np.nan)
        for e in excursions:
            end = np.minimum(hits[e.exits[0]], hits[e.exits[1]])
            for liquidated in (hits[k] for k in e.exits[2:]):
                end = np.where((liquidated < stop) & (liquidated <= hits[e.exits[0]]), liquidated, end)
            for name, (side, largest) in (("best", e.best), ("worst", e.worst)):
                value = table(side, largest).of(start, end)
                at = table(side, largest).first(start, end, value)
                made[f"{e.out}_{name}"], made[f"{e.out}_{name}_at"] = value, np.where(np.isnan(value), np.nan, at - start)
        out = []
        for f in fields:
            whole = np.full(size, np.nan)
            whole[rows] = made[f]
            out.append(whole)
        return out

    return in_blocks(df, fields, work, keys, core_only=True)


__all__ = ["Extremes", "Touch", "Excursion", "ahead"]
