"""Products of all pairs of columns in one pass: moments of complete pairs, summed up in a tree, read out in long form.

The columns of a row are one vector with gaps.  A task keeps, for a band of columns against all columns, the number of
complete pairs, both means and the three centred second moments, and merges batch after batch into them; at its end it
hands on one row per column of the band.  These rows are merged in two steps, first a few tasks' rows at a time.  The plan has
the same size for four columns and for four thousand, and the driver sees none of the numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Columns of a band; a task holds six numbers for each pair of a band's column and any column.
BAND = 512
#: Rows merged by one task of the first step.
FAN = 64


def _moments(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """(6, band, width): pairs, mean and mean, second moments xx, yy and xy of complete pairs of some rows."""
    known = ~np.isnan(x)
    n_col = known.sum(axis=0)
    centre = np.where(n_col > 0, np.where(known, x, 0.0).sum(axis=0) / np.maximum(n_col, 1), 0.0)
    v, m = np.where(known, x - centre, 0.0), known.astype(np.float64)
    a, ma = v[:, first:last], m[:, first:last]
    n = ma.T @ m
    some = np.maximum(n, 1.0)
    sx, sy = a.T @ m, ma.T @ v
    mx, my = sx / some, sy / some
    xx, yy, xy = (a * a).T @ m - n * mx * mx, ma.T @ (v * v) - n * my * my, a.T @ v - n * mx * my
    return np.stack([n, mx + centre[first:last, None], my + centre[None, :], xx, yy, xy])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together."""
    n = a[0] + b[0]
    some = np.maximum(n, 1.0)
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / some
    share = b[0] / some
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


_ROWS = "i int, part int, moments array<double>"


def pair_moments(cells: DataFrame, width: int) -> DataFrame:
    """(i, j, n, mean_i, mean_j, var_i, var_j, cov) of all pairs i < j, from rows (at array<int>, value array<double>) of ``width`` columns.

    Variances and covariances are those of a population of the complete pairs.
    """
    def partial(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((6, last - first, width))
            for batch in batches:
                if not batch.num_rows:
                    continue
                at, value = batch.column("at"), batch.column("value")
                x = np.full((batch.num_rows, width), np.nan)
                rows = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
                x[rows, at.flatten().to_numpy()] = value.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                total = _merged(total, _moments(x, first, last))
            for k in range(last - first):
                yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int32()), pa.array([0], pa.int32()), pa.array([total[:, k].ravel()], pa.list_(pa.float64()))],
                                                 ["i", "part", "moments"])
        return run

    def merge(t: pa.Table) -> np.ndarray:
        x = np.stack([np.asarray(m.as_py()).reshape(6, -1) for m in t.column("moments")])
        total = x[0]
        for other in x[1:]:
            total = _merged(total, other)
        return total

    def first_step(t: pa.Table) -> pa.Table:
        return pa.table({"i": t.column("i")[:1], "part": t.column("part")[:1], "moments": pa.array([merge(t).ravel()], pa.list_(pa.float64()))})

    def second_step(t: pa.Table) -> pa.Table:
        i, m = t.column("i")[0].as_py(), merge(t)
        j = np.arange(i + 1, width)
        n = m[0, j]
        some = np.maximum(n, 1.0)
        return pa.table({"i": pa.array(np.full(len(j), i), pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(n.astype(np.int64)),
                         **{k: pa.array(v) for k, v in zip(("mean_i", "mean_j", "var_i", "var_j", "cov"), (m[1, j], m[2, j], m[3, j] / some, m[4, j] / some, m[5, j] / some))}})

    out = None
    for first in range(0, width, BAND):
        part = cells.select("at", "value").mapInArrow(partial(first, min(first + BAND, width)), _ROWS)
        part = part.withColumn("part", (F.spark_partition_id() / FAN).cast("int"))
        out = part if out is None else out.unionByName(part)
    some = out.groupBy("i", "part").applyInArrow(first_step, _ROWS)
    return some.groupBy("i").applyInArrow(second_step, "i int, j int, n long, mean_i double, mean_j double, var_i double, var_j double, cov double")


def with_correlation(moments: DataFrame, least: float = 0.0) -> DataFrame:
    """Adds corr, NULL where a side does not move, within -1 .. 1."""
    spread = F.sqrt(F.col("var_i") * F.col("var_j"))
    moves = (F.col("var_i") > least) & (F.col("var_j") > least)
    return moments.withColumn("corr", F.when(moves, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / F.when(spread > 0, spread)))))


__all__ = ["pair_moments", "with_correlation"]
