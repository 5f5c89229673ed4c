"""Sets of row numbers per condition: a table turned on its side, in slices.

A slice holds some rows in one record: for each condition the sorted numbers of the rows that meet it, 16 bits each, and how often
every row counts, how often with a target, and the sum of its targets.  A rule's rows are a bit mask, the AND of its conditions; what each further condition would leave of it is counted for
all conditions in one sweep over the slice's numbers.  So a round over any number of conditions reads every slice once, moves only counts,
and needs neither a join of rows with rules nor a shuffle of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from barlens.functions.core import no_nan
from barlens.session import settings, written

ROWS_PER_SLICE = 1 << 16
_SLICE = "slice long, rows int, conditions array<string>, ends array<int>, numbers binary, n binary, k binary, s binary"
_COUNTS = "rule int, condition string, n long, k long, s double"
#: A slice record is large, so a worker takes one at a time.
_ONE = {"spark__sql__execution__arrow__maxRecordsPerBatch": "1"}


def vertical(df: DataFrame, target: str, conditions: str, rows_per_slice: int = ROWS_PER_SLICE, sums: Sequence[str] | None = None) -> DataFrame:
    """Slices of (target, conditions array<string>), written once; ``sums`` names rows, rows with a target and its sum where a row stands for several."""
    assert rows_per_slice <= 1 << 16, "row numbers have 16 bits"

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId() << 32, [], 0

        def one(t: pa.Table, at: int) -> pa.RecordBatch:
            lists = t.column("c").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            row, code = np.repeat(np.arange(len(lists)), sizes), coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
            n, k, s = (t.column(v).to_numpy() for v in ("n", "k", "s"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part + at]), pa.array([len(lists)], pa.int32()), pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
                 pa.array([ends], pa.list_(pa.int32())), pa.array([row[order].astype(np.uint16).tobytes()]),
                 pa.array([n.astype(np.int64).tobytes()]), pa.array([k.astype(np.int64).tobytes()]), pa.array([s.astype(np.float64).tobytes()])],
                ["slice", "rows", "conditions", "ends", "numbers", "n", "k", "s"])

        at = 0
        for batch in batches:
            while batch.num_rows:
                take = min(rows_per_slice - n, batch.num_rows)
                held.append(batch.slice(0, take))
                batch, n = batch.slice(take), n + take
                if n == rows_per_slice:
                    yield one(pa.Table.from_batches(held), at)
                    held, n, at = [], 0, at + 1
        if n:
            yield one(pa.Table.from_batches(held), at)

    y = no_nan(F.col(target).cast("double"))
    each = [F.lit(1), y.isNotNull().cast("int"), y] if sums is None else [F.col(v) for v in sums]
    n, k, s = (F.coalesce(v.cast(kind), F.lit(0).cast(kind)) for v, kind in zip(each, ("long", "long", "double")))
    given = df.select(n.alias("n"), k.alias("k"), s.alias("s"), F.coalesce(F.col(conditions), F.array().cast("array<string>")).alias("c"))
    return written(given.mapInArrow(turn, _SLICE), "slices")


def extended(slices: DataFrame, rules: Sequence[Sequence[str]]) -> DataFrame:
    """(rule, condition, n, k, s): rows that meet rule number ``rule`` and the condition too, how many of them have a target, and its sum.

    The rules come with the task, so they must be few; conditions of the rule itself are left out.
    """
    rules = [list(r) for r in rules]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, ends = batch.column("conditions")[i].as_py(), np.asarray(batch.column("ends")[i].as_py(), np.int64)
                if not names:
                    continue
                numbers = np.frombuffer(batch.column("numbers")[i].as_py(), np.uint16)
                w = {v: np.frombuffer(batch.column(v)[i].as_py(), kind) for v, kind in (("n", np.int64), ("k", np.int64), ("s", np.float64))}
                at, starts = {c: j for j, c in enumerate(names)}, np.concatenate([[0], ends[:-1]])

                def mask(condition: str) -> np.ndarray:
                    bits = np.zeros(len(w["n"]), bool)
                    bits[numbers[starts[at[condition]]:ends[at[condition]]]] = True
                    return bits

                out = []
                for r, rule in enumerate(rules):
                    if any(c not in at for c in rule):
                        continue
                    bits = np.logical_and.reduce([mask(c) for c in rule])
                    if not bits.any():
                        continue
                    # every condition has a row, so no run is empty
                    n, k, s = (np.add.reduceat((bits * w[v])[numbers], starts) for v in ("n", "k", "s"))
                    n[[at[c] for c in rule]] = 0
                    some = np.flatnonzero(n)
                    out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(some), r), pa.int32()), pa.array([names[j] for j in some], pa.string()),
                                                           pa.array(n[some]), pa.array(k[some]), pa.array(s[some])], ["rule", "condition", "n", "k", "s"]))
                yield from out

    with settings(slices.sparkSession, **_ONE):
        # the counts of a task are added up before they are shuffled
        sums = slices.mapInArrow(count, _COUNTS).groupBy("rule", "condition").agg(*[F.sum(c).alias(c) for c in ("n", "k", "s")])
        return written(sums, "extended")


__all__ = ["vertical", "extended"]
