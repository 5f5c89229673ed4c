"""Exact quantiles of groups of any size.

``percentile`` keeps one map per group in one task.  Here equal values are
counted first (map-side) and the counts are written, so that slices, totals and scan do not count again; they are accumulated in value order with
:func:`barlens.plans.ordered.running`, so a hot group is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from barlens.plans.ordered import running
from barlens.session import written


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    rows_per_slice: int | None = None, times: str | None = None) -> DataFrame:
    """One row per key: linear-interpolation quantile ``probs[name]`` as ``name``, and ``n``; ``times`` names how often a row counts."""
    keys = list(keys)
    const = not keys
    if const:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg((F.sum(times) if times else F.count(F.lit(1))).alias("_c")))
    counts = written(counts, "counts")
    cum = running(counts, keys, ["_v"], {"_cum": ("sum", F.col("_c"))}, rows_per_slice=rows_per_slice)
    total = counts.groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]).agg(F.sum("_c").alias("n"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    j = cum.join(total, cond)
    aggs = []
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [F.min(F.when(F.col("_cum") > lo, F.col("_v"))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_cum") > hi, F.col("_v"))).alias(f"_hi_{name}")]
    g = j.groupBy(*keys, "n").agg(*aggs)
    out = [F.col(k) for k in keys if not const] + [F.col("n")]
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return g.select(*out)
