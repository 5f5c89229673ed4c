"""Sort, limit, top-k, caps and samples (K*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.functions.core import c


def top_by(df: DataFrame, by: list, k: int) -> DataFrame:
    """Distributed top-n: each task keeps n rows before they meet."""
    return df.orderBy(*by).limit(k)


def top_bottom_k(df: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """Best and worst k rows of each group.

    The two rank filters are applied separately, so both are cut map-side
    before the groups are gathered, however large a group is.
    """
    up = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    dn = Window.partitionBy(*keys).orderBy(F.asc(value), tie)
    best = df.withColumn("pos", F.row_number().over(up)).filter(F.col("pos") <= k).withColumn("side", F.lit("best"))
    worst = df.withColumn("pos", F.row_number().over(dn)).filter(F.col("pos") <= k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


def page(df: DataFrame, cond: Column, order: list, limit: int, offset: int) -> DataFrame:
    return df.filter(cond).orderBy(*order).offset(offset).limit(limit)


def rank_candidates(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cap_by_cumulative(df: DataFrame, keys: list[str], order: list, exposure: str, max_rows: int, max_exposure: float,
                      cluster: str, max_cluster: int) -> DataFrame:
    """Ranked rows while their number, exposure and cluster share stay within limits.

    Only the first ``max_rows`` per group can pass, so the group is cut to them
    first (map-side); the running limits then look at a handful of rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_rows)
    run = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"cum_exposure": F.sum(exposure).over(run),
                       "cluster_pos": F.row_number().over(Window.partitionBy(*keys, cluster).orderBy("rank"))})
    return x.filter((F.col("cum_exposure") <= max_exposure) & (F.col("cluster_pos") <= max_cluster))


def stratified_sample(df: DataFrame, strata: list[str], id_col: str, n: int, seed: str = "42") -> DataFrame:
    """n rows per stratum in the order of a hash of (seed, id): the same rows on every run."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")))
    w = Window.partitionBy(*strata).orderBy("_h", id_col)
    return df.withColumn("_h", h).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_h", "_k")


__all__ = ["top_by", "top_bottom_k", "latest_per_key", "page", "rank_candidates", "cap_by_cumulative", "stratified_sample", "c"]
