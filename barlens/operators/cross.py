"""Cross-sectional and multi-series operators (X*).

A cross-section holds one row per listed symbol, so windows over ``ts`` are
small whatever the length of the history or the volume of one symbol.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.functions.core import c, clip, div, ln
from barlens.functions.stats import corr_agg
from barlens.operators.windows import RN, lag, r_beta, r_corr, r_mean, r_std, r_sum, r_zscore, when_ready, pair, w_corr
from barlens.plans.gram import pair_moments, with_correlation
from barlens.plans.ordered import blocked, core_rows, frame
from barlens.session import written


def _x(*more: str):
    return Window.partitionBy("ts", *more)


def cs_rank_avg(x, *by: str) -> Column:
    """Average-tie rank among the non-NULL values of the cross-section."""
    x = c(x)
    w = _x(*by).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(Window.partitionBy("ts", *by, x))
    return F.when(x.isNotNull(), F.rank().over(w) + (ties - 1) / 2.0)


def cs_rank_pct(x, *by: str) -> Column:
    return cs_rank_avg(x, *by) / F.count(c(x)).over(_x(*by))


def cs_position(x, *by: str) -> Column:
    """0-based position, ties by symbol."""
    x = c(x)
    return F.when(x.isNotNull(), F.row_number().over(_x(*by).orderBy(x.asc_nulls_last(), F.col("symbol"))) - 1)


def cs_rank_unit(x, *by: str) -> Column:
    """Position scaled to 0..1; a lone value gets 0.5."""
    n = F.count(c(x)).over(_x(*by))
    return F.when(c(x).isNotNull(), F.when(n == 1, 0.5).otherwise(div(cs_position(x, *by), n - 1)))


def cs_rank_center(x) -> Column:
    """(position + 0.5) / n where three or more rows exist, else the raw value."""
    n = F.count(F.lit(1)).over(_x())
    pos = F.row_number().over(_x().orderBy(c(x).asc_nulls_last(), F.col("symbol"))) - 1
    return F.when(n >= 3, (pos + 0.5) / n).otherwise(c(x))


def cs_rank_matrix(df: DataFrame, cols: list[str], min_rows: int = 3) -> DataFrame:
    """``cs_rank_center`` of many columns at once.

    The wide rows are placed by ts once and ranked in Arrow batches: cross-sections of one size form a block (times, symbols,
    columns), whose second axis is sorted for all of them in one call.  A window per column would sort every partition
    once per column, and unpivoting would multiply the rows.  A cross-section
    holds one row per symbol and always fits a batch buffer; one that runs over
    the end of a batch is carried into the next.
    """
    import numpy as np
    import pyarrow as pa

    def rank(it):
        rest = []
        for batch in it:
            if not batch.num_rows:
                continue
            t = batch.column("ts").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(t, t[-1]))  # sorted by ts: the last cross-section may go on
            if rest and cut == 0 and rest[0].column("ts")[0] == batch.column("ts")[0]:
                rest.append(batch)
                continue
            whole = [*rest, batch.slice(0, cut)]
            yield ranked(pa.Table.from_batches(whole))
            rest = [batch.slice(cut)]
        if rest:
            yield ranked(pa.Table.from_batches(rest))

    def ranked(table):
        t = table.column("ts").to_numpy()
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(t)])
        x = np.column_stack([table.column(k).to_numpy() for k in cols]).astype(np.float64)
        for n in np.unique(size[size >= min_rows]):
            at = start[size == n][:, None] + np.arange(n)
            # rows arrive by (ts, symbol): a stable sort lets ties keep symbol order, NaN comes last
            order = np.argsort(x[at], axis=1, kind="stable")
            place = np.empty(order.shape)
            np.put_along_axis(place, order, (np.arange(n)[None, :, None] + 0.5) / n, axis=1)
            x[at] = place
        made = [pa.array(x[:, j], mask=np.isnan(x[:, j])) for j in range(len(cols))]
        return pa.RecordBatch.from_arrays([table.column("symbol").combine_chunks(), table.column("ts").combine_chunks(), *made], keep)

    keep = ["symbol", "ts", *cols]
    d = df.select("symbol", "ts", *[F.col(k).cast("double").alias(k) for k in cols])
    fields = ", ".join(["symbol string", "ts timestamp", *[f"`{k}` double" for k in cols]])
    return d.repartition("ts").sortWithinPartitions("ts", "symbol").select(*keep).mapInArrow(rank, fields)


def cs_zscore(x, *by: str) -> Column:
    x = c(x)
    return div(x - F.avg(x).over(_x(*by)), F.stddev_samp(x).over(_x(*by)))


def universe_median(df: DataFrame, x: str, out: str) -> DataFrame:
    return df.groupBy("ts").agg(F.percentile(x, F.lit(0.5)).alias(out))


def corr_with_median(df: DataFrame, n: int = 20, z: int = 20) -> DataFrame:
    """On a blocked table with ``ret`` and ``median_ret``."""
    df = df.withColumn("correlation_with_median", r_corr("ret", "median_ret", n, 5))
    return df.withColumn("correlation_zscore", r_zscore("correlation_with_median", z, 2, ddof=0))


def rank_group(df: DataFrame) -> DataFrame:
    """Ranks of momentum, volatility and volume (columns mom_1, mom_2, mom_3, vol, volume)."""
    return df.withColumns({
        "rank_momentum_1h": cs_rank_unit("mom_1"), "rank_momentum_4h": cs_rank_unit("mom_2"),
        "rank_momentum_24h": cs_rank_unit("mom_3"), "rank_volatility": cs_rank_unit("vol"),
        "rank_volume": cs_rank_unit("volume")})


def windowed_return(n: int) -> Column:
    """Sum of the log returns of a window with at least two values (blocked table)."""
    return r_sum("ret", n, 2)


def with_benchmark(df: DataFrame, bench: str, cols: dict[str, str], how: str = "left") -> DataFrame:
    """Columns of one symbol on every row of the same time.

    One row per timestamp: an equi-join on ts, left to the optimizer to
    broadcast by size.
    """
    b = df.filter(F.col("symbol") == bench).select("ts", *[F.col(k).alias(v) for k, v in cols.items()])
    return df.join(b, "ts", how)


def residual_return(df: DataFrame, n: int = 20, mp: int = 5) -> DataFrame:
    """beta and ret - beta*bench_ret on a blocked table with ``ret`` and ``bench_ret``."""
    df = df.withColumn("residual_beta", r_beta("ret", "bench_ret", n, mp))
    return df.withColumn("residual_momentum", F.col("ret") - F.col("residual_beta") * F.col("bench_ret"))


def symbol_profiles(df: DataFrame, n: int = 20) -> DataFrame:
    """Latest beta, volatility of the last n returns, sum of the last five residuals."""
    def last_k(x, k):
        # the last k of a symbol are among the last k of its months, so no sort holds a whole symbol
        newest = (F.when(c(x).isNull(), 1).otherwise(0), F.col("ts").desc())
        near = F.row_number().over(Window.partitionBy("symbol", F.date_trunc("month", "ts")).orderBy(*newest)) <= k
        return near, lambda flag: F.col(flag) & (F.row_number().over(Window.partitionBy("symbol", flag).orderBy(*newest)) <= k)

    near5, last5 = last_k("residual_momentum", 5)
    near_n, last_n = last_k("ret", n)
    d = df.withColumns({"_m5": near5, "_mn": near_n})
    beta = d.groupBy("symbol").agg(F.max_by("residual_beta", F.when(F.col("residual_beta").isNotNull(), F.col("ts"))).alias("beta"))
    d = d.where("_m5 or _mn").withColumns({"_k5": last5("_m5"), "_kn": last_n("_mn")})
    return beta.join(d.groupBy("symbol").agg(
        F.stddev_samp(F.when(F.col("_kn"), F.col("ret"))).alias("vol"),
        F.sum(F.when(F.col("_k5"), F.col("residual_momentum"))).alias("mom")), "symbol").fillna(0.0)


def cluster_symbols(profiles: DataFrame, cols: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """k-means++ over symbol profiles with Spark ML."""
    v = VectorAssembler(inputCols=cols, outputCol="_f", handleInvalid="skip").transform(profiles)
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster_id", initMode="k-means||").fit(v)
    return model.transform(v).drop("_f")


def lead_lag_group(df: DataFrame, n: int = 20, max_lag: int = 5, vol_n: int = 20, min_valid: int = 5) -> DataFrame:
    """Pair features against a context series on a blocked table (``ret``, ``ctx_ret``)."""
    w = frame(n)
    p, q = pair("ret", "ctx_ret")
    up_p, up_c = F.sum(p).over(w), F.sum(q).over(w)
    rc = F.expm1(up_c)
    rel = when_ready(F.when(F.abs(rc) >= 1e-10, div(F.expm1(up_p), rc)), p, n, 2, True, w)
    pv, cv = r_std("ret", vol_n), r_std("ctx_ret", vol_n)
    ratio = F.when(cv >= 1e-14, div(pv, cv))
    align = F.when(RN() >= vol_n, 2.0 * (2.0 / math.pi) * F.atan(ratio) - 1.0)
    df = df.withColumns({"correlation_pairwise": r_corr("ret", "ctx_ret", n, min_valid),
                         "relative_strength": rel, "tf_alignment": align})
    shifts = {}
    for k in range(-max_lag, max_lag + 1):
        col = F.col("ctx_ret") if k == 0 else (lag("ctx_ret", k) if k > 0 else F.lead("ctx_ret", -k).over(frame()))
        # the shifted context window must lie inside the series
        name = f"_c{k + max_lag}"
        shifts[name] = col
    df = df.withColumns(shifts)
    cands = []
    for k in range(-max_lag, max_lag + 1):
        a, b = pair("ret", f"_c{k + max_lag}")
        moving = (F.stddev_pop(a).over(w) >= 1e-14) & (F.stddev_pop(b).over(w) >= 1e-14)
        r = F.when(moving & (F.count(a).over(w) >= min_valid), clip(w_corr(a, b, w), -1.0, 1.0))
        if k < 0:  # rows after the current one must exist
            r = F.when(F.lead("rn", -k).over(frame()).isNotNull(), r)
        cands.append(F.struct(F.abs(r).alias("a"), F.lit(-(k + max_lag)).alias("o"),
                              F.lit(float((k > 0) - (k < 0))).alias("s")))
    best = F.array_max(F.filter(F.array(*cands), lambda z: z["a"].isNotNull()))
    df = df.withColumn("lead_lag_score", F.when(RN() >= n + max_lag - 1, best["s"] * best["a"]))
    return df.drop(*shifts)


def cluster_rotation(df: DataFrame, clusters: DataFrame, n: int = 20, min_valid: int = 5, rows_per_block: int | None = None) -> DataFrame:
    """1 - mean correlation of each symbol with the other members of its cluster, clipped to 0..1.

    ``df`` has (symbol, ts, ret), ``clusters`` (symbol, cluster).  Pairs are in long form, one series for each (symbol, other), so
    the plan does not depend on how many symbols or members there are.
    """
    mine = clusters.join(clusters.select("cluster", F.col("symbol").alias("other")), "cluster").where("symbol <> other").select("symbol", "other")
    pairs = df.select("symbol", "ts", "ret").join(mine, "symbol").join(
        df.select(F.col("symbol").alias("other"), "ts", F.col("ret").alias("other_ret")), ["other", "ts"], "left")
    keys = ("symbol", "other")
    b = blocked(pairs, n, keys=keys, rows_per_block=rows_per_block)
    w = frame(n, keys=keys)
    a, o = pair("ret", "other_ret")
    moving = (F.stddev_pop(a).over(w) >= 1e-14) & (F.stddev_pop(o).over(w) >= 1e-14)
    r = F.when(moving, clip(w_corr(a, o, w), -1.0, 1.0))
    b = core_rows(b.withColumn("_r", when_ready(r, a, n, min_valid, True, w)))
    return b.groupBy("symbol", "ts").agg(F.when(F.count("_r") > 0, clip(1.0 - F.avg("_r"), 0.0, 1.0)).alias("cluster_rotation"))


def correlation_pairs(df: DataFrame, cols: list[str], fill: float | None = 0.0) -> DataFrame:
    """Pearson for every pair of columns (a, b, corr), however many; gaps become ``fill``, or leave the row out of the pair if it is None."""
    value = F.array(*[F.coalesce(F.col(k).cast("double"), F.lit(fill)) if fill is not None else F.col(k).cast("double") for k in cols])
    cells = df.select(F.sequence(F.lit(0), F.lit(len(cols) - 1)).alias("at"), value.alias("value"))
    names = F.array(*[F.lit(k) for k in cols])
    return with_correlation(pair_moments(cells, len(cols))).select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "corr")


def symbol_correlations(df: DataFrame, x: str) -> DataFrame:
    """(a, b, n, corr) of every pair of symbols over the times both have a value.  The driver learns how many symbols there are."""
    known = written(df.where(F.col(x).isNotNull()).select("symbol", "ts", F.col(x).cast("double").alias("_x")), "cells")
    index = written(known.select("symbol").distinct().withColumn("_i", F.row_number().over(Window.orderBy("symbol")) - 1), "symbols")
    width = index.count()
    cells = known.join(index, "symbol").groupBy("ts").agg(F.collect_list("_i").alias("at"), F.collect_list("_x").alias("value"))
    c = with_correlation(pair_moments(cells, width))
    a, b = (index.select(F.col("_i").alias(i), F.col("symbol").alias(s)) for i, s in (("i", "a"), ("j", "b")))
    return c.join(a, "i").join(b, "j").select("a", "b", "n", "corr")


__all__ = [k for k in list(globals()) if not k.startswith("_")] + ["ln", "r_mean"]
