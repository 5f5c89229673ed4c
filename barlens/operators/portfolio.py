"""Equity curves, drawdowns and the cross-sectional momentum portfolio (W57, L18..L20)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from barlens.functions.core import c, div
from barlens.plans.ordered import running
from barlens.session import written


def equity_curve(df: DataFrame, keys: list[str], order: list[str], r: str, *, rows_per_slice: int | None = None,
                 slice_col: Column | None = None) -> DataFrame:
    """Running sum of results, its running peak (never below 0) and the drawdown.

    One ordered scan per slice gives the local sum and its local peak; the
    slices' sums and highest points carry both over.
    """
    from barlens.plans.ordered import with_slices
    keys, order = list(keys), list(order)
    x = df.withColumn("_r", F.coalesce(F.col(r), F.lit(0.0)))
    s = x.withColumn("_slice", slice_col) if slice_col is not None else with_slices(x, keys, order, rows_per_slice)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_e", F.sum("_r").over(w)).withColumn("_m", F.max("_e").over(w))
    g = s.groupBy(*keys, "_slice").agg(F.sum("_r").alias("_sum"), F.max("_e").alias("_hi"))
    wk = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_base", F.coalesce(F.sum("_sum").over(wk), F.lit(0.0)))
    g = g.withColumn("_top", F.greatest(F.coalesce(F.max(F.col("_base") + F.col("_hi")).over(wk), F.lit(0.0)), F.lit(0.0)))
    g = g.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), "_base", "_top")
    cond = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    j = s.join(g, cond)
    j = j.withColumns({"equity": F.col("_base") + F.col("_e"), "peak": F.greatest(F.col("_top"), F.col("_base") + F.col("_m"))})
    return j.withColumn("drawdown", F.col("peak") - F.col("equity")).select(*df.columns, "equity", "peak", "drawdown")


_SLICE_DRAWDOWN = "_slice int, _sum double, _hi double, _lo double, _dd double"


def max_drawdown(df: DataFrame, keys: list[str], order: list[str], r: str, out: str = "max_drawdown",
                 rows_per_slice: int | None = None, groups: Column | None = None) -> DataFrame:
    """Largest fall of the running sum per key, equity starting at 0.

    The rows are range-partitioned by ``order`` alone.  A range gives for each key its sum,
    its highest and lowest prefix and its own drawdown, and those few rows are
    combined in order.  One move of keys, order and result, whatever the group size.
    ``groups`` is an array of structs with the fields ``keys``: a row counts for each of them, and is multiplied only
    where its range is read.
    """
    from barlens.plans.ordered import ROWS_PER_SLICE
    keys, order = list(keys), list(order)
    x = df.select(*([F.col(k) for k in keys] if groups is None else [groups.alias("_groups")]), *order, F.coalesce(F.col(r).cast("double"), F.lit(0.0)).alias("_r"))
    x = written(x, "results")  # the count and the sampling of ranges read this again, not the input
    x = x.repartitionByRange(max(1, -(-x.count() // (rows_per_slice or ROWS_PER_SLICE // 4))), *order)
    if groups is not None:
        x = x.select(F.explode("_groups").alias("_g"), *order, "_r").select(*[F.col(f"_g.{k}").alias(k) for k in keys], *order, "_r")
    of = x.select(*keys)
    types = list(to_arrow_schema(of.schema))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in of.schema.fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key and order; a key that goes on in the next batch keeps its state."""
        part, done, state = TaskContext.get().partitionId(), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("_r").to_numpy()
            cuts = [0, *_changes(batch, keys), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(batch.column(k)[lo].as_py() for k in keys)
                if state is None or state[0] != key:
                    done += [state] if state else []
                    state = [key, 0.0, -math.inf, math.inf, 0.0]
                e = np.cumsum(np.concatenate([[state[1]], values[lo:hi]]))[1:]
                tops = np.maximum.accumulate(np.concatenate([[max(state[2], 0.0)], e]))[1:]
                state[1:] = [float(e[-1]), max(state[2], float(e.max())), min(state[3], float(e.min())), max(state[4], float((tops - e).max()))]
        done += [state] if state else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0][i] for d in done], f.type) for i, f in enumerate(types)] + [pa.array([part] * len(done), pa.int32())]
                                             + [pa.array([d[i] for d in done]) for i in range(1, 5)], [*keys, "_slice", "_sum", "_hi", "_lo", "_dd"])

    g = x.sortWithinPartitions(*keys, *order).select(*keys, "_r").mapInArrow(fold, fields + _SLICE_DRAWDOWN)
    wk = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_base", F.coalesce(F.sum("_sum").over(wk), F.lit(0.0)))
    g = g.withColumn("_prev", F.greatest(F.max(F.col("_base") + F.col("_hi")).over(wk), F.lit(0.0)))
    fall = F.greatest(F.col("_dd"), F.coalesce(F.col("_prev"), F.lit(0.0)) - (F.col("_base") + F.col("_lo")))
    return g.groupBy(*keys).agg(F.max(F.greatest(fall, F.lit(0.0))).alias(out))


def _changes(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Row numbers at which the key differs from the row before."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new).tolist()


def compound_curve(df: DataFrame, keys: list[str], order: list[str], ret: str, rows_per_slice: int | None = None) -> DataFrame:
    """Compounded equity from period returns and its relative drawdown, in slices of a key (see ``plans.ordered.running``).

    The product is carried as logarithm, sign and zero count, so returns at or below
    -100 % are handled too.
    """
    g = 1.0 + F.col(ret)
    e = running(df, keys, order, {"_logs": ("sum", F.when(g != 0, F.log(F.abs(F.when(g != 0, g))))), "_neg": ("count", F.when(g < 0, 1)),
                                  "_zero": ("count", F.when(g == 0, 1))}, rows_per_slice=rows_per_slice)
    sign = F.when(F.col("_zero") > 0, 0.0).when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    e = e.withColumn("equity", sign * F.exp(F.coalesce("_logs", F.lit(0.0)))).drop("_logs", "_neg", "_zero")
    e = running(e, keys, order, {"_p": ("max", F.col("equity"))}, rows_per_slice=rows_per_slice)
    e = e.withColumn("_p", F.greatest("_p", F.lit(1.0)))
    return e.withColumn("drawdown", (F.col("equity") - F.col("_p")) / F.col("_p")).drop("_p")


def return_metrics(df: DataFrame, keys: list[str], order: list[str], ret: str, per_year: float, rows_per_slice: int | None = None) -> DataFrame:
    """Net return, Sharpe, profit factor and maximum drawdown of period returns."""
    e = compound_curve(df, keys, order, ret, rows_per_slice)
    r = F.col(ret)
    last = F.struct(*order)
    pos, neg = F.sum(F.when(r > 0, r).otherwise(0.0)), F.abs(F.sum(F.when(r < 0, r).otherwise(0.0)))
    sd = F.stddev_pop(r)
    return e.groupBy(*keys).agg(
        (F.max_by("equity", last) - 1.0).alias("net_return"),
        F.when((F.count(r) > 1) & (sd > 0), div(F.avg(r), sd) * math.sqrt(per_year)).otherwise(0.0).alias("sharpe"),
        div(pos, neg).alias("profit_factor"), F.min("drawdown").alias("max_drawdown"))


# fixed values: windows, weights, shares and costs of the momentum portfolio
XS = dict(windows=(1, 4, 12, 24), weights=(0.1, 0.2, 0.3, 0.4), share=0.2, every=4, taker=0.00045, slippage=0.0005,
          buffer=0.001, max_side=4)


def momentum_positions(panel: DataFrame, cfg: dict | None = None, random_seed: int | None = None) -> DataFrame:
    """Long the top and short the bottom share by weighted momentum at each rebalance.

    ``panel`` has (symbol, ts, ti, mom_1..mom_k, next_ret), ti counting distinct
    times.  With ``random_seed`` the order is a hash of (seed, ts, symbol).
    """
    p = {**XS, **(cfg or {})}
    wsum = sum(p["weights"])
    score = sum((F.col(f"mom_{w}") * (g / wsum) for w, g in zip(p["windows"], p["weights"])), F.lit(0.0))
    d = panel.withColumn("score", score)
    start = max(p["windows"])
    d = d.filter((F.col("ti") >= start) & ((F.col("ti") - start) % p["every"] == 0) & F.col("score").isNotNull())
    by = F.col("score").desc() if random_seed is None else F.md5(F.concat_ws("|", F.lit(str(random_seed)), F.unix_seconds("ts").cast("string"), "symbol"))
    w = Window.partitionBy("ts")
    d = d.withColumns({"rank": F.row_number().over(w.orderBy(by, F.col("symbol"))) - 1, "n": F.count(F.lit(1)).over(w)})
    k = F.greatest(F.lit(1), F.floor(F.col("n") * p["share"] + 1e-9))
    d = d.withColumn("direction", F.when(F.col("rank") < k, 1).when(F.col("rank") >= F.col("n") - k, -1))
    d = d.filter(F.col("direction").isNotNull())
    if random_seed is None:
        d = d.filter(F.abs("score") >= 2 * (p["taker"] + p["slippage"]) + p["buffer"])
        d = d.withColumn("_k", F.row_number().over(w.orderBy("rank"))).filter(F.col("_k") <= 2 * p["max_side"]).drop("_k")
    return d


def portfolio_returns(positions: DataFrame, cfg: dict | None = None) -> DataFrame:
    """Mean next-bar return of the positions minus the charge, per rebalance."""
    p = {**XS, **(cfg or {})}
    return positions.groupBy("ts", "ti").agg(F.avg(F.col("next_ret") * F.col("direction")).alias("gross"),
                                             F.count(F.lit(1)).alias("n_positions")) \
        .withColumn("ret", F.coalesce("gross", F.lit(0.0)) - (p["taker"] + p["slippage"]))


__all__ = [k for k in list(globals()) if not k.startswith("_")] + ["c"]
