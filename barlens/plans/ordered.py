"""Ordered work that does not put a whole key into one task.

``Window.partitionBy(key)`` sends every row of a key to one task.  That is fine
for a few thousand bars and fatal when one symbol holds a third of a large
table.  Two layouts replace it:

``running``  prefix aggregates (sum, max, last ...).  A key is cut into ordered
             slices, each slice is scanned on its own, and a small table of
             slice totals carries the state over.
``blocked``  finite windows.  A key is cut into blocks of consecutive rows and
             each block gets copies of the rows just before (and after) it, so
             that every window function sees its full frame inside the block.

Both are exact: where the cuts lie changes only the balance, not the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.session import written

ROWS_PER_SLICE = 4_000_000
ROWS_PER_BLOCK = 8_192
COLD = 40  # rows at the edge of a block that no window ahead of a recurrence exceeds


def with_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                rows_per_slice: int | None = None, out: str = "_slice") -> DataFrame:
    """Add an ordered slice label (array<long>) per row.

    The table is range-partitioned by keys and order, whatever their types, and the partition number is the label: inside a
    key it grows with the order, a slice holds about ``rows_per_slice`` rows, and no key, instant or common
    beginning of a text is one slice unless the whole order is tied.  The labelled table is written once, so that
    totals and scan see the same cuts.  The input is written before that, so that counting and sampling do not compute it again.
    """
    df = written(df, "unsliced")
    n = -(-df.count() // (rows_per_slice or ROWS_PER_SLICE))
    if n <= 1:
        return df.withColumn(out, F.array(F.lit(0).cast("long")))
    cut = df.repartitionByRange(int(n), *keys, *order)
    return written(cut.withColumn(out, F.array(F.spark_partition_id().cast("long"))), "slices")


_TOTAL = {
    "sum": lambda e, o: F.sum(e),
    "count": lambda e, o: F.count(e),
    "max": lambda e, o: F.max(e),
    "min": lambda e, o: F.min(e),
    "last": lambda e, o: F.max_by(e, F.when(e.isNotNull(), o)),
    "first": lambda e, o: F.min_by(e, F.when(e.isNotNull(), o)),
}
_LOCAL = {
    "sum": lambda e: F.sum(e), "count": lambda e: F.count(e), "max": lambda e: F.max(e),
    "min": lambda e: F.min(e), "last": lambda e: F.last(e, True), "first": lambda e: F.first(e, True),
}


def _join_up(kind, carry, local):
    if kind == "sum":
        return F.when(carry.isNotNull() | local.isNotNull(),
                      F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)))
    if kind == "count":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    return F.coalesce(carry, local)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            aggs: dict[str, tuple[str, Column]], *, exclusive: bool = False,
            rows_per_slice: int | None = None, slice_col: Column | None = None) -> DataFrame:
    """Prefix aggregates of each key in ``order`` (a total order).

    ``aggs`` maps an output name to ``(kind, expression)`` with kind one of
    sum, count, max, min, last, first; NULL is skipped.  ``exclusive`` leaves
    the current row out.  ``slice_col`` gives a ready, order-preserving slice
    (for bars: the month) and saves the pass that looks for hot keys.
    """
    keys, order = list(keys), list(order)
    s = df.withColumn("_slice", slice_col) if slice_col is not None else \
        with_slices(df, keys, order, rows_per_slice)
    for name, (_, e) in aggs.items():
        s = s.withColumn(f"_in_{name}", e)
    o = F.struct(*order)
    totals = s.groupBy(*keys, "_slice").agg(
        *[_TOTAL[k](F.col(f"_in_{n}"), o).alias(f"_t_{n}") for n, (k, _) in aggs.items()])
    wc = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_cs"),
        *[_carry(kind, n, wc) for n, (kind, _) in aggs.items()])
    end = -1 if exclusive else 0
    wl = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = s.select("*", *[_LOCAL[k](F.col(f"_in_{n}")).over(wl).alias(f"_l_{n}")
                            for n, (k, _) in aggs.items()])
    cond = F.col("_slice") == F.col("_cs")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_c{i}"))
    j = local.join(carry, cond, "left")
    keep = [F.col(x) for x in df.columns if x not in aggs]
    return j.select(*keep, *[_join_up(k, F.col(f"_p_{n}"), F.col(f"_l_{n}")).alias(n)
                             for n, (k, _) in aggs.items()])


def _carry(kind, n, w):
    f = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}.get(kind)
    e = f(f"_t_{n}") if f else (F.last(f"_t_{n}", True) if kind == "last" else F.first(f"_t_{n}", True))
    return e.over(w).alias(f"_p_{n}")


def with_position(df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",),
                  out: str = "rn", unit: str | None = "month") -> DataFrame:
    """0-based row number per key.

    Bars are unique per (key, ts), so a calendar slice holds a bounded number of
    rows and is a ready slice.  Other tables pass ``unit=None``.
    """
    sl = F.date_trunc(unit, F.col(order[0])) if unit else None
    return running(df, keys, order, {out: ("count", F.lit(1))}, slice_col=sl) \
        .withColumn(out, (F.col(out) - 1).cast("long"))


def blocked(df: DataFrame, lookback: int, lookahead: int = 0, *, keys: Sequence[str] = ("symbol",),
            order: Sequence[str] = ("ts",), rows_per_block: int | None = None,
            unit: str | None = "month") -> DataFrame:
    """Cut each key into blocks of consecutive rows with overlapping edges.

    Adds ``rn`` (0-based position in the key), ``blk``, ``core`` (true for
    the one copy of a row that belongs to the block) and ``zone``: -1 and 0 copies
    from the block before (the first few are -1: windows over them are cut short),
    1 own rows that come before the next block's zone 0, 2 the other own rows, 3 copies
    from the block behind.  Evaluate windows over ``(keys, blk)`` ordered by
    ``rn``, then call :func:`core_rows`.
    """
    # copied rows stay below an eighth of a block unless a size is given
    size = max(rows_per_block, lookback, lookahead, 1) if rows_per_block else \
        max(ROWS_PER_BLOCK, 8 * (lookback + lookahead))
    p = df if "rn" in df.columns else with_position(df, keys, order, unit=unit)  # a position at hand is reused
    home = F.floor(F.col("rn") / F.lit(size))
    inside = F.col("rn") % F.lit(size)
    targets = [home]
    if lookback > 0:
        targets.append(F.when(inside >= size - lookback, home + 1))
    if lookahead > 0:
        targets.append(F.when((inside < lookahead) & (home > 0), home - 1))
    handed_over = inside < size - lookback + min(COLD, lookback // 8)
    blk = F.col("blk")
    return (p.withColumn("_home", home)
            .withColumn("blk", F.explode(F.array_compact(F.array(*targets))))
            .withColumn("core", blk == F.col("_home"))
            .withColumn("zone", F.when(blk > F.col("_home"), F.when(handed_over, -1).otherwise(0))
                        .when(blk < F.col("_home"), 3).otherwise(F.when(handed_over, 1).otherwise(2)).cast("int")).drop("_home"))


def core_rows(df: DataFrame, drop: Sequence[str] = ("rn",)) -> DataFrame:
    return df.filter("core").drop("blk", "core", "zone", *drop)


def frame(n: int | None = None, *, keys: Sequence[str] = ("symbol",), start: int | None = None,
          end: int = 0):
    """Window over a blocked table: the last ``n`` rows, or ``start .. end``."""
    w = Window.partitionBy(*keys, "blk").orderBy("rn")
    if n is None and start is None:
        return w
    return w.rowsBetween(-(n - 1) if start is None else start, end)
