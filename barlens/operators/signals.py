"""Signal events and randomisation tests (E12..E16)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barlens.functions.core import c
from barlens.operators.joins import thin_by_min_gap
from barlens.plans.draws import permuted, times_drawn
from barlens.plans.ordered import running
from barlens.plans.quantiles import exact_quantiles
from barlens.session import written


def factor_signal_events(df: DataFrame, value: str, pct: float, direction: str, gap_seconds: float, min_rows: int = 100) -> DataFrame:
    """Rows beyond a quantile of the symbol's history, thinned by a minimum gap.

    'long' takes values above the ``pct`` quantile, 'short' below 1 - pct.
    """
    q = exact_quantiles(df, ["symbol"], value, {"_q": pct if direction == "long" else 1.0 - pct}).filter(F.col("n") >= min_rows)
    j = df.join(q.select("symbol", "_q"), "symbol")
    hit = j.filter(F.col(value) > F.col("_q")) if direction == "long" else j.filter(F.col(value) < F.col("_q"))
    ev = hit.select("symbol", "ts", F.col(value).alias("signal_value"), F.col("close").alias("entry_price"))
    return thin_by_min_gap(ev, ["symbol"], gap_seconds).withColumn("direction", F.lit(direction.upper()))


def shuffle_null_test(df: DataFrame, key: str, direction: str, r: str, n: int, seed: int = 42) -> DataFrame:
    """Mean result after permuting the directions, per iteration, and whether it reaches the real mean.

    Of a permutation only this matters: which rows get one of the LONGs.  Rows are numbered in the order of key and result, a keyed
    permutation of the numbers is worked out per row and iteration (``plans.draws.permuted``), and the rows whose number becomes
    less than the count of LONGs get one.  Nothing is copied or joined: a task adds up its rows for all iterations.
    """
    numbered = running(df.select(key, direction, r), [], [key, r], {"_k": ("count", F.lit(1))})
    v = F.when(F.col(direction) == "LONG", F.col(r)).otherwise(-F.col(r))
    size, longs, real = df.agg(F.count(F.lit(1)), F.count(F.when(F.col(direction) == "LONG", 1)), F.avg(v)).first()  # one row of three numbers

    def sums(batches):
        total, rows = np.zeros(n), 0
        for batch in batches:
            k, x = batch.column("k").to_numpy(), batch.column("x").to_numpy(zero_copy_only=False)
            known = ~np.isnan(x)
            rows += int(known.sum())
            for i in range(n):
                total[i] += np.where(permuted(k[known], size, seed, i) < longs, x[known], -x[known]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total), pa.array(np.full(n, rows))], ["iteration", "s", "c"])

    out = numbered.select((F.col("_k") - 1).alias("k"), F.col(r).cast("double").alias("x")).mapInArrow(sums, "iteration long, s double, c long")
    return out.groupBy("iteration").agg((F.sum("s") / F.sum("c")).alias("mean_r")).withColumn("beats_real", F.col("mean_r") >= F.lit(real))


def block_bootstrap_ci(df: DataFrame, order: list[str], r: str, block: int, resamples: int, seed: int = 42, rows_per_slice: int | None = None) -> DataFrame:
    """2.5 / 97.5 % of resampled means; blocks of consecutive rows are drawn with replacement, as many as there are.

    The rows become one (sum, count) per block.  How often a resample draws each block is split down a tree over the blocks
    (``plans.draws.times_drawn``), every split drawn from a hash of its node.  So a task finds the counts of its own blocks, no
    draw is a row, and one row per resample and task is added up.
    """
    p = running(df.select(*dict.fromkeys([*order, r])), [], order, {"_i": ("count", F.lit(1))}, rows_per_slice=rows_per_slice)
    bl = written(p.groupBy(F.floor((F.col("_i") - 1) / F.lit(block)).alias("b")).agg(F.sum(r).cast("double").alias("s"), F.count(F.lit(1)).alias("c")), "blocks")
    nb = bl.count()

    def sums(batches):
        s, c = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            order_of = np.argsort(batch.column("b").to_numpy(), kind="stable")
            b, bs, bc = (batch.column(k).to_numpy(zero_copy_only=False)[order_of] for k in ("b", "s", "c"))
            for at, times in times_drawn(b, nb, resamples, seed):
                s += times * np.nan_to_num(bs[at])
                c += times * bc[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(s), pa.array(c)], ["i", "s", "c"])

    m = bl.repartitionByRange("b").sortWithinPartitions("b").mapInArrow(sums, "i long, s double, c double")
    m = m.groupBy("i").agg((F.sum("s") / F.sum("c")).alias("m"))
    q = exact_quantiles(m, [], "m", {"ci_lower": 0.025, "ci_upper": 0.975}).drop("n")
    return q.withColumns({"mean_r": df.select(F.avg(r)).scalar(), "n_blocks": F.lit(nb)})


def rescue_class(r) -> Column:
    r = c(r)
    return (F.when(r > 0.02, "KEEP").when(r < -0.3, "REJECT_FOREVER").when(r < -0.1, "SEGMENT_RESCUE_CANDIDATE")
            .when((r < 0) & (r >= -0.05), "NOISE_NEAR_ZERO").when(r < 0, "FEATURE_ONLY").otherwise("RETEST_REQUIRED"))


def family_by_words(name, words: list[tuple[str, str]]) -> Column:
    """First family whose pattern occurs in the lower-cased name."""
    out = F
    for fam, pattern in words:
        out = out.when(F.lower(c(name)).rlike(pattern), fam)
    return out.otherwise("other")


__all__ = [k for k in list(globals()) if not k.startswith("_")]
