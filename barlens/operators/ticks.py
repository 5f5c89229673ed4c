"""Tick features per time bucket (A1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barlens.functions.core import div
from barlens.plans.ordered import running
from barlens.plans.quantiles import exact_quantiles
from barlens.sources.tables import bucket


def tick_features(ticks: DataFrame, freq: str, rows_per_slice: int | None = None) -> DataFrame:
    """Counts, volumes, imbalance, share of large trades, VWAP and return spread per bucket.

    The previous trade of a bucket is a prefix value and the median size an
    exact distributed quantile, so one bucket may hold a large part of the ticks.
    """
    t = ticks.withColumn("_b", bucket("ts", freq))
    order = ["ts", "event_id"]
    t = running(t, ["symbol", "_b"], order, {"_prev": ("last", F.col("price"))}, exclusive=True, rows_per_slice=rows_per_slice)
    med = exact_quantiles(t, ["symbol", "_b"], "size", {"_med": 0.5}, rows_per_slice).drop("n")
    t = t.join(med, ["symbol", "_b"])
    s, buy = F.col("size"), F.col("side") == "buy"
    bv, sv = F.sum(F.when(buy, s).otherwise(0.0)), F.sum(F.when(buy, 0.0).otherwise(s))
    vwap = div(F.sum(F.col("price") * s), F.sum(s))
    first = F.min_by("price", F.struct(*order))
    return t.groupBy("symbol", F.col("_b").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(s).alias("volume"), bv.alias("buy_volume"), sv.alias("sell_volume"),
        div(bv - sv, F.sum(s)).alias("imbalance"), F.avg(F.when(s > 2 * F.col("_med"), 1.0).otherwise(0.0)).alias("large_share"),
        vwap.alias("vwap"), (div(vwap, first) - 1.0).alias("vwap_deviation"),
        F.stddev_samp(div("price", "_prev") - 1.0).alias("ret_std"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def aggtrade_features(ticks: DataFrame, freq: str, as_of: str = "full") -> DataFrame:
    """Mean and spread of price, quantity, maker share, imbalance and a burst z-score.

    The bucket is known at its end (``ts_available``).  as_of='full' compares the
    trade count with the whole sample, 'expanding' with the symbol's past only.
    """
    t = ticks.withColumn("_b", bucket("ts", freq))
    s, buy = F.col("size"), F.col("side") == "buy"
    g = t.groupBy("symbol", F.col("_b").alias("ts_start")).agg(
        F.avg("price").alias("mean_price"), F.stddev_samp("price").alias("std_price"), F.sum(s).alias("qty"),
        F.count(F.lit(1)).alias("trades"), F.avg(F.when(buy, 0.0).otherwise(1.0)).alias("maker_share"),
        div(F.sum(F.when(buy, s).otherwise(-s)), F.sum(s)).alias("imbalance"))
    g = g.withColumn("ts_available", F.col("ts_start") + F.expr(f"interval {freq}"))
    if as_of == "full":
        m = g.agg(F.avg("trades").alias("m"), F.stddev_samp("trades").alias("s"))
        return g.withColumn("burst_z", div(F.col("trades") - m.select("m").scalar(), m.select("s").scalar()))
    past = running(g, ["symbol"], ["ts_start"], {"_n": ("count", F.lit(1)), "_s": ("sum", F.col("trades").cast("double")),
                                                 "_q": ("sum", (F.col("trades") * F.col("trades")).cast("double"))},
                   exclusive=True, slice_col=F.date_trunc("month", F.col("ts_start")))
    n, mean = F.col("_n"), div("_s", "_n")
    var = div(F.col("_q") - n * mean * mean, n - 1)
    return past.withColumn("burst_z", div(F.col("trades") - mean, F.sqrt(F.when(var > 0, var)))).drop("_n", "_s", "_q")


__all__ = ["tick_features", "aggtrade_features", "Window"]
