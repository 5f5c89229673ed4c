"""Exponential means as linear recurrences y[t] = a[t]*y[t-1] + b[t], exact for any cut into blocks.

The rows of a block are scanned from zero, with the share that is left of the start.  A block is summed up by one row; a fold
over these few rows gives the level each block starts from, however many NULL rows or whole blocks lie in between.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barlens.functions.core import c
from barlens.session import written

DECADES = 40.0  # exp(-40) is below double precision


def lookback_for(k: float) -> int:
    """Rows after which a term decaying by (1-k) per row is below rounding."""
    return int(math.ceil(DECADES / -math.log1p(-k))) if k < 1 else 1


@dataclass
class Ema:
    """One mean with weight ``k`` on the new value.

    seed='first': starts at the first value, NULL until ``min_periods`` values.
    seed='sma'  : starts at the n-th value with the mean of the first ``n``, NULL before; later NULLs keep the level.
    gaps=True   : a NULL still ages the old level (weights by position).
    """

    x: str | Column
    k: float
    out: str
    seed: str = "first"
    n: int = 1
    min_periods: int = 1
    gaps: bool = False


def _scan(x: np.ndarray, s: Ema) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values so far, y, l) per row of a block: the mean that starts with 0 at the first value, and the log of what is left of that start."""
    valid = ~np.isnan(x)
    seen = np.cumsum(valid)
    at = np.flatnonzero(valid)
    y, l = np.zeros(len(x)), np.zeros(len(x))
    if len(at):
        first = at[0]
        from_zero = x[first:].copy()
        from_zero[0] = 0.0
        y[first:] = pd.Series(from_zero).ewm(alpha=s.k, adjust=False, ignore_na=not s.gaps).mean().to_numpy()
        step = np.zeros(len(x))
        step[at[1:]] = np.log(np.maximum(_weights(s, np.diff(at).astype(float))[0], 1e-300))
        l = np.cumsum(step)
    return seen, y, l


def _weights(s: Ema, age):
    """Weights of the level and of a new value that comes ``age`` rows after the last."""
    old = (1.0 - s.k) ** age if s.gaps else (1.0 - s.k) * np.ones_like(age)
    return (old / (old + s.k), s.k / (old + s.k)) if s.gaps else (old, s.k * np.ones_like(age))


def _rows(specs: tuple[Ema, ...]):
    """Rows of a block in order, with the scan of each mean."""
    def rows(block: pa.Table) -> pa.Table:
        block = block.sort_by("rn")
        cold = block.column("zone").to_numpy() < 0
        for i, s in enumerate(specs):
            x = block.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float)
            x[cold] = np.nan
            for name, values in zip(("_i", "_y", "_l"), _scan(x, s)):
                block = block.append_column(f"{name}{i}", pa.array(values.astype(float)))
        return block
    return rows


def _summary(specs: tuple[Ema, ...]):
    """One row per block: for each mean the number and sum of its own values that are not handed over again, the first value and
    its row, the last row with a value, y and l where the next block begins, and the first n values."""
    def summary(block: pa.Table) -> pa.Table:
        block = block.sort_by("rn")
        zone, rn = block.column("zone").to_numpy(), block.column("rn").to_numpy().astype(float)
        own, out = (zone == 0) | (zone == 1), []
        for i, s in enumerate(specs):
            x = block.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float)
            x[zone < 0] = np.nan
            valid = np.flatnonzero(~np.isnan(x))
            mine = valid[own[valid]]
            end = np.flatnonzero(own)[-1:]
            y, l = (float(block.column(f"{c}{i}")[int(end[0])].as_py()) if len(end) else 0.0 for c in ("_y", "_l"))
            head = x[valid[:s.n]] if s.seed == "sma" else x[:0]
            out.append([len(mine), x[mine].sum(), *((x[valid[0]], rn[valid[0]]) if len(valid) else (np.nan, np.nan)), rn[mine[-1]] if len(mine) else np.nan, y, l, *head])
        return pa.table({"symbol": block.column("symbol")[:1], "blk": block.column("blk")[:1], "sums": pa.array([out], pa.list_(pa.list_(pa.float64())))})
    return summary


def _starts(specs: tuple[Ema, ...]):
    """Blocks of a symbol in order: values seen before each, the level before it, and z, the level after its first value.

    A row of the block is then y + exp(l) * z.  The fold takes one small row per block.
    """
    def starts(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("blk")
        sums = blocks.column("sums").to_pylist()
        out = {f"_s{i}": [] for i in range(len(specs))}
        for i, s in enumerate(specs):
            need = s.n if s.seed == "sma" else 1
            seen, total, last, level = 0, 0.0, None, None
            for block in sums:
                n, add, first, at, end, y, l, *head = block[i]
                z = None
                if at == at:  # the block has a value
                    if seen >= need:
                        left, new = (float(w[0]) for w in _weights(s, np.array([at - last])))
                        z = left * level + new * first
                    elif s.seed == "first":
                        z = first
                    elif len(head) >= need - seen:  # the value that completes the seed is in here
                        head = head[:need - seen]
                        mean = (total + sum(head)) / s.n
                        scanned = 0.0
                        for v in head[1:]:
                            scanned = (1.0 - s.k) * scanned + s.k * v
                        z = (mean - scanned) / (1.0 - s.k) ** (len(head) - 1)
                out[f"_s{i}"].append({"seen": float(seen), "level": level, "z": z})
                if n:
                    seen, total, last = seen + int(n), total + add, end
                    level = y + float(np.exp(l)) * z if seen >= need else None
        kind = pa.struct([("seen", pa.float64()), ("level", pa.float64()), ("z", pa.float64())])
        return pa.table({"symbol": blocks.column("symbol"), "blk": blocks.column("blk"), **{k: pa.array(v, kind) for k, v in out.items()}})
    return starts


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], more])


def emas(df: DataFrame, *specs: Ema) -> DataFrame:
    """Add exponential means to a blocked table; specs that do not depend on each other go together.

    The rows of a block, which has a bounded size, are scanned in one pass and written, as sums and rows both come from them.
    """
    for s in specs:
        if s.seed not in ("first", "sma"):
            raise ValueError(f"unknown seed {s.seed!r}")
    group, ids = ["symbol", "blk"], range(len(specs))
    df = df.withColumns({f"_x{i}": c(s.x).cast("double") for i, s in enumerate(specs)})
    specs = tuple(replace(s, x=f"_x{i}") for i, s in enumerate(specs))  # columns do not travel to the workers
    made = ", ".join(f"_i{i} double, _y{i} double, _l{i} double" for i in ids)
    rows = written(df.groupBy(*group).applyInArrow(_rows(specs), _schema(df, made)), "emas")
    key = f"symbol {df.schema['symbol'].dataType.simpleString()}, blk {df.schema['blk'].dataType.simpleString()}"
    sums = rows.select(*group, "rn", "zone", *[f"_{p}{i}" for i in ids for p in "xyl"]).groupBy(*group).applyInArrow(_summary(specs), f"{key}, sums array<array<double>>")
    starts = sums.groupBy("symbol").applyInArrow(_starts(specs), f"{key}, " + ", ".join(f"_s{i} struct<seen: double, level: double, z: double>" for i in ids))
    rows = rows.join(starts, group, "left")
    out = {}
    for i, s in enumerate(specs):
        level = F.when(F.col(f"_i{i}") == 0, F.col(f"_s{i}.level")).otherwise(F.col(f"_y{i}") + F.exp(f"_l{i}") * F.col(f"_s{i}.z"))
        ready = (F.col("zone") >= 0) & (F.col(f"_s{i}.seen") + F.col(f"_i{i}") >= (s.n if s.seed == "sma" else max(1, s.min_periods)))
        out[s.out] = F.when(ready, level)
    return rows.withColumns(out).drop(*[f"_{p}{i}" for i in ids for p in "xiyls"])


def ema(df: DataFrame, x: str | Column, k: float, out: str, **options) -> DataFrame:
    """One exponential mean; see :class:`Ema` for the options."""
    return emas(df, Ema(x, k, out, **options))
