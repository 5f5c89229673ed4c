"""Time axis: resampling, alignment, filling (TS*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlens.functions.core import c
from barlens.operators.windows import lead
from barlens.plans.ordered import blocked, core_rows, running, with_position
from barlens.sources.tables import bars_of as ticks_to_bars  # noqa: F401  (TS1)
from barlens.sources.tables import bucket, bucket_ceil


def resample_bars(bars: DataFrame, freq: str) -> DataFrame:
    """Calendar resampling: first open, highest high, lowest low, last close, summed volume."""
    extra = [F.sum(x).alias(x) for x in ("quote_volume", "trade_count", "taker_buy_volume") if x in bars.columns]
    g = bars.filter(F.col("close").isNotNull()).groupBy("symbol", bucket("ts", freq).alias("_w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), *extra)
    return g.select("symbol", F.col("_w").alias("ts"), *[x for x in g.columns if x not in ("symbol", "_w")])


def resample_bars_by_count(bars: DataFrame, k: int) -> DataFrame:
    """Blocks of k consecutive bars; ``ts_last`` is the bar the block becomes known at."""
    p = with_position(bars).withColumn("block", F.floor(F.col("rn") / F.lit(k)))
    return p.groupBy("symbol", "block").agg(
        F.min("ts").alias("ts"), F.max("ts").alias("ts_last"), F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"))


def ffill_resample(series: DataFrame, freq: str) -> DataFrame:
    """Sparse series to a regular grid: each value is repeated until the next one.

    The repetition is generated from the value and the time of its successor, so
    neither a grid join nor a window over the filled rows is needed.
    """
    step = F.expr(f"interval {freq}")
    b = blocked(series, 0, 1).withColumn("_next", lead("ts"))
    b = core_rows(b)
    start = bucket_ceil("ts", freq)
    stop = F.when(F.col("_next").isNotNull(), bucket_ceil("_next", freq) - step).otherwise(start)
    grid = F.when(stop >= start, F.sequence(start, F.greatest(start, stop), step))
    return b.withColumn("ts", F.explode(grid)).drop("_next")


def symbol_list(df: DataFrame) -> Column:
    """The universe as an array; one entry per listed symbol, so it is small."""
    return df.select(F.array_sort(F.collect_set("symbol"))).scalar()


def align_union(bars: DataFrame) -> DataFrame:
    """Every timestamp seen anywhere, for every symbol; holes are NULL."""
    grid = bars.select("ts").distinct().withColumn("symbol", F.explode(symbol_list(bars)))
    return grid.join(bars, ["ts", "symbol"], "left")


def align_intersection(bars: DataFrame) -> DataFrame:
    """Only timestamps at which every symbol has a bar ((symbol, ts) is unique)."""
    n = bars.select(F.countDistinct("symbol")).scalar()
    full = bars.groupBy("ts").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n).select("ts")
    return bars.join(full, "ts", "left_semi")


def reindex_overlay(grid: DataFrame, overlay: DataFrame, value: str, out: str) -> DataFrame:
    return grid.join(overlay.select("symbol", "ts", F.col(value).alias(out)), ["symbol", "ts"], "left")


def bucket_last(df: DataFrame, freq: str, value: str = "value", tie: str | None = None) -> DataFrame:
    at = F.struct("ts", tie) if tie else F.col("ts")
    return df.groupBy("symbol", bucket("ts", freq).alias("_b")).agg(F.max_by(value, at).alias(value)) \
        .withColumnRenamed("_b", "ts")


def resample_daily(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.max_by("close", "ts").alias("close"))


def stretch_context(bars: DataFrame, context: DataFrame, k: int, features: list[str],
                    partial: bool = True) -> DataFrame:
    """Bring features of k-bar blocks back to the bars.

    A block's value holds from its last bar on until the next block ends; an
    unfinished last block (``partial``) shows on the last bar only.  ``context``
    has (symbol, block) and the features; NULL values keep the value before.
    """
    filled = running(context.select("symbol", "block", *features), ["symbol"], ["block"],
                     {f: ("last", F.col(f)) for f in features}, slice_col=F.floor(F.col("block") / 65536))
    p = with_position(bars)
    known = F.floor((F.col("rn") + 1) / F.lit(k)) - 1
    if partial:
        ends = p.groupBy("symbol").agg(F.max("rn").alias("_end"))
        p = p.join(ends, "symbol")
        known = F.when(F.col("rn") == F.col("_end"), F.floor(F.col("rn") / F.lit(k))).otherwise(known)
    p = p.withColumn("block", known)
    return p.join(filled, ["symbol", "block"], "left").drop("rn", "block", "_end")


def normalize_ts(x: str | Column) -> Column:
    """Epoch seconds, milliseconds, nanoseconds or ISO text to a UTC timestamp."""
    x = c(x)
    text = x.cast("string")
    num = text.try_cast("double") if hasattr(text, "try_cast") else F.expr(f"try_cast({text} as double)")
    a = F.abs(num)
    ms = F.when(a > 1e17, num / 1e6).when(a > 1e14, num / 1e3).when(a > 1e12, num).otherwise(num * 1000.0)
    return F.when(num.isNotNull(), F.timestamp_millis(F.floor(ms).cast("long"))) \
        .otherwise(F.try_to_timestamp(text))


# fixed values: bar intervals in minutes
INTERVAL_MINUTES = {"1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360,
                    "8h": 480, "12h": 720, "1d": 1440, "3d": 4320, "1w": 10080}
# fixed values: the context interval of each trading interval
HIGHER_INTERVAL = {"1m": "5m", "5m": "15m", "15m": "1h", "30m": "4h", "1h": "4h", "2h": "1d", "4h": "1d", "6h": "1d",
                   "12h": "3d", "1d": "7d", "3d": "1M", "7d": "1M", "14d": "1M"}


def _lookup(table: dict, key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, key)


def interval_minutes(x) -> Column:
    return _lookup(INTERVAL_MINUTES, c(x))


def minutes_interval(x) -> Column:
    return _lookup({v: k for k, v in INTERVAL_MINUTES.items()}, c(x))


def higher_interval(x) -> Column:
    return _lookup(HIGHER_INTERVAL, c(x))
