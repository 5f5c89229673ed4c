"""Greedy choices along an order: keep a row, pass over all rows closer than a gap, keep the next.

Every row points to the row that would be kept after it.  A key is cut into chunks of consecutive rows.  Inside a chunk the
pointers are followed for all rows at once by doubling.  Between chunks only those rows matter at which a chain can enter a chunk,
the rows within a gap of the chunk before; each of them points to the place where its chain enters a later chunk.  Which
of these places the chain from the key's first row really takes is found by doubling again: a round knows twice as many chunks
and its pointers reach twice as far, so the rounds are the logarithm of the number of chunks, on any data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from barlens.plans.ordered import running, with_position
from barlens.session import written


def _pointers(x: np.ndarray, gap) -> list[np.ndarray]:
    """The row kept 1, 2, 4, ... places after each row, len(x) where there is none."""
    n = len(x)
    out = [np.append(np.maximum(np.searchsorted(x, x + gap, side="left"), np.arange(n) + 1), n)]
    while (out[-1][:n] < n).any():
        out.append(out[-1][out[-1]])
    return out


def last_kept(x: np.ndarray, gap) -> np.ndarray:
    """For a chain that starts at each row, the last row of the chunk that it keeps."""
    n = len(x)
    at = np.arange(n)
    for jump in reversed(_pointers(x, gap)):
        to = jump[at]
        at = np.where(to < n, to, at)
    return at


def kept_from(x: np.ndarray, gap, first: int) -> np.ndarray:
    """Which rows the chain from row ``first`` keeps."""
    n = len(x)
    keep = np.zeros(n + 1, dtype=bool)
    if first < n:
        keep[first] = True
        jumps = _pointers(x, gap)
        for jump in jumps:
            keep[jump[np.flatnonzero(keep[:n])]] = True
    return keep[:n]


def orbit(pointers: DataFrame, start: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows on the chains from ``start`` along ``pointers`` (keys, at, to), and how many rounds it took.

    Each round adds what the pointers say of the known rows and joins the pointers with themselves.
    """
    known, jump, rounds = written(start, "orbit"), written(pointers.where("to is not null"), "jump"), 0
    on = [*keys, "at"]
    while not jump.isEmpty():
        rounds += 1
        known = written(known.unionByName(known.join(jump, on).select(*keys, F.col("to").alias("at"))), "orbit")
        far = jump.select(*keys, F.col("at").alias("to"), F.col("to").alias("_far"))
        jump = written(jump.join(far, [*keys, "to"]).select(*keys, "at", F.col("_far").alias("to")), "jump")
    return known, rounds


def thinned(df: DataFrame, keys: Sequence[str], order: str, gap: float, *, rows_per_chunk: int = 200_000, unit: str | None = "month") -> tuple[DataFrame, int]:
    """Rows of the greedy choice, the first of each key included, and the number of rounds between chunks.

    ``gap`` is in seconds for timestamps, else in units of ``order``.  Rows equal in ``order`` keep the place they first get: the positions are written once.
    """
    keys = list(keys)
    instant = dict(df.dtypes)[order].startswith("timestamp")
    x: Column = F.unix_micros(F.col(order).cast("timestamp")) if instant else F.col(order).cast("double")
    step = int(round(gap * 1e6)) if instant else float(gap)
    base = with_position(df, keys, [order], out="_rn", unit=unit if instant else None)
    base = written(base.withColumns({"_chunk": F.floor(F.col("_rn") / F.lit(rows_per_chunk)), "_x": x}), "thin")
    cols, kind = df.columns, "bigint" if instant else "double"
    key_fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn").reset_index(drop=True)
        first = int(pdf["_first"].iloc[0] - pdf["_rn"].iloc[0])
        return pdf.loc[kept_from(pdf["_x"].to_numpy(), step, first), cols]

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn").reset_index(drop=True)
        v, before = pdf["_x"].to_numpy(), pdf["_before"].iloc[0]
        n = 1 if pd.isna(before) else min(int(np.searchsorted(v, before + step, side="left")) + 1, len(v))
        at = last_kept(v, step)[:n]
        return pd.DataFrame({**{k: pdf[k].iloc[:n] for k in keys}, "at": pdf["_rn"].iloc[:n], "_x": v[:n], "_ask": v[at] + step})

    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    if base.filter("_chunk > 0").isEmpty():
        return base.withColumn("_first", F.lit(0).cast("long")).groupBy(*keys, "_chunk").applyInPandas(emit, out_schema), 0
    ends = base.groupBy(*keys, "_chunk").agg(F.max("_x").alias("_before")).withColumn("_chunk", F.col("_chunk") + 1)
    doors = written(base.select(*keys, "_chunk", "_rn", "_x").join(ends, [*keys, "_chunk"], "left").groupBy(*keys, "_chunk")
                    .applyInPandas(entries, f"{key_fields}, at bigint, _x {kind}, _ask {kind}"), "doors")
    # the next door at or after a row's wish: both in one stream against the order, the last door carried along
    stream = (doors.select(*keys, (-F.col("_x")).alias("_o"), F.lit(0).alias("_side"), (-F.col("at")).alias("_tie"), F.col("at").alias("_door"))
              .unionByName(doors.select(*keys, (-F.col("_ask")).alias("_o"), F.lit(1).alias("_side"), (-F.col("at")).alias("_tie"), F.lit(None).cast("long").alias("_door"))))
    carried = running(stream, keys, ["_o", "_side", "_tie"], {"_to": ("last", F.col("_door"))})
    pointers = carried.filter("_side = 1").select(*keys, (-F.col("_tie")).alias("at"), F.col("_to").alias("to"))
    taken, rounds = orbit(pointers, doors.filter("at = 0").select(*keys, "at"), keys)
    first = taken.select(*keys, F.floor(F.col("at") / F.lit(rows_per_chunk)).alias("_chunk"), F.col("at").alias("_first"))
    return base.join(first, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(emit, out_schema), rounds


def rounds_for(chunks: int) -> int:
    """The most rounds that a chain over so many chunks takes."""
    return max(math.ceil(math.log2(max(chunks, 1))) + 1, 1)


__all__ = ["last_kept", "kept_from", "orbit", "thinned", "rounds_for"]
