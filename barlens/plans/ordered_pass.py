"""One ordered, stateful pass per key for rules that are not linear.

A key is cut into chunks of consecutive rows.  Every chunk is scanned at once
from a guessed start state; then the start states are corrected to the end
state of the chunk before, and only the chunks whose start state changed are
scanned again.  Resetting rules forget their start quickly, so two or three
rounds usually do; the loop ends only when every start state is the true one.
State rows (one per chunk) are cut off from their lineage with checkpoints.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from barlens.plans.ordered import with_position
from barlens.session import cut_lineage

ROWS_PER_CHUNK = 200_000

# step(rows, state) -> (output columns as a frame aligned with rows, end state)
Step = Callable[[pd.DataFrame, "list[float] | None"], "tuple[pd.DataFrame, list[float]]"]


def ordered_pass(df: DataFrame, step: Step, out_fields: str, *, keys: Sequence[str] = ("symbol",),
                 order: Sequence[str] = ("ts",), rows_per_chunk: int = ROWS_PER_CHUNK,
                 unit: str | None = "month") -> DataFrame:
    """Append the columns of ``out_fields`` computed by ``step`` over the rows of each key."""
    keys, order = list(keys), list(order)
    base = with_position(df, keys, order, out="_rn", unit=unit)
    base = base.withColumn("_chunk", F.floor(F.col("_rn") / F.lit(rows_per_chunk)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out_schema = f"{fields}, {out_fields}"
    cols = df.columns

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn").reset_index(drop=True)
        made, _ = step(pdf, _state_of(pdf))
        return pd.concat([pdf[cols], made], axis=1)

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn").reset_index(drop=True)
        _, end = step(pdf, _state_of(pdf))
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, "_chunk": pdf["_chunk"].iloc[0], "_end": [float(x) for x in end]}])

    key_fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    probe_schema = f"{key_fields}, _chunk bigint, _end array<double>"
    on = keys + ["_chunk"]
    no_state = F.lit(None).cast("array<double>")

    if base.filter("_chunk > 0").isEmpty():
        return (base.withColumn("_state", no_state).groupBy(*on)
                .applyInPandas(emit, out_schema))

    ends = base.withColumn("_state", no_state).groupBy(*on).applyInPandas(probe, probe_schema)
    states = cut_lineage(ends.withColumn("_state", no_state))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    while True:
        want = states.withColumn("_want", F.lag("_end").over(w))
        want = cut_lineage(want)
        dirty = want.filter(~F.col("_want").eqNullSafe(F.col("_state")))
        if dirty.isEmpty():
            break
        redo = (base.join(dirty.select(*on, F.col("_want").alias("_state")), on)
                .groupBy(*on).applyInPandas(probe, probe_schema).withColumnRenamed("_end", "_end2"))
        states = cut_lineage(want.join(redo, on, "left").select(
            *on, F.coalesce("_end2", "_end").alias("_end"), F.col("_want").alias("_state")))
    fixed = states.select(*on, "_state")
    return base.join(fixed, on).groupBy(*on).applyInPandas(emit, out_schema)


# summary(rows) -> numbers that tell how a chunk turns any start state into its end state
Summary = Callable[[pd.DataFrame], "list[float]"]
# advance(summary, state) -> end state
Advance = Callable[["list[float]", "list[float] | None"], "list[float]"]


def folded_pass(df: DataFrame, step: Step, summary: Summary, advance: Advance, out_fields: str, *, keys: Sequence[str] = ("symbol",),
                order: Sequence[str] = ("ts",), rows_per_chunk: int = ROWS_PER_CHUNK, unit: str | None = "month") -> DataFrame:
    """:func:`ordered_pass` for rules whose effect on the state can be summed up per chunk: two passes, however many chunks.

    The first pass sums up every chunk; one row per chunk is folded over each key, which gives the state every chunk
    starts from; the second pass emits the rows.
    """
    keys, order = list(keys), list(order)
    base = with_position(df, keys, order, out="_rn", unit=unit)
    base = base.withColumn("_chunk", F.floor(F.col("_rn") / F.lit(rows_per_chunk)))
    cols, on = df.columns, [*keys, "_chunk"]
    key_fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out_fields}"

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn").reset_index(drop=True)
        made, _ = step(pdf, _state_of(pdf))
        return pd.concat([pdf[cols], made], axis=1)

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn").reset_index(drop=True)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in on}, "_sum": [float(v) for v in summary(pdf)]}])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk").reset_index(drop=True)
        state, starts = None, []
        for summed in pdf["_sum"]:
            starts.append(state)
            state = [float(v) for v in advance(list(summed), state)]
        return pd.DataFrame({**{k: pdf[k] for k in on}, "_state": starts})

    if base.filter("_chunk > 0").isEmpty():
        return base.withColumn("_state", F.lit(None).cast("array<double>")).groupBy(*on).applyInPandas(emit, out_schema)
    sums = cut_lineage(base.groupBy(*on).applyInPandas(sum_up, f"{key_fields}, _chunk bigint, _sum array<double>"))
    starts = sums.groupBy(*keys).applyInPandas(states, f"{key_fields}, _chunk bigint, _state array<double>")
    return base.join(starts, on).groupBy(*on).applyInPandas(emit, out_schema)


def _state_of(pdf: pd.DataFrame):
    s = pdf["_state"].iloc[0]
    return None if s is None else list(s)
