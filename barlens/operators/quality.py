"""Data quality checks on bar tables (DQ*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlens.functions.core import c, ieee_div
from barlens.operators.windows import lag
from barlens.plans.ordered import blocked, core_rows, running


def _prev(df: DataFrame, order: list[str]) -> DataFrame:
    return core_rows(blocked(df, 1, order=order, unit="month").withColumn("_prev", lag("ts")))


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key.  An aggregate, so a huge pile of copies is merged map-side."""
    rest = [x for x in df.columns if x not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*keys, "_r.*")


def detect_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows after the first of each key.  Only the first per key is joined back."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n")) \
        .filter(F.col("_n") > 1).drop("_n")
    return df.join(first, keys).filter(F.struct(*order) > F.col("_first")).drop("_first")


def detect_gaps(df: DataFrame, minutes: int, *, dedup: bool = True) -> DataFrame:
    """(symbol, expected, actual) where a bar does not follow the one before.

    ``dedup=False`` keeps repeated timestamps, which then show up as gaps too.
    """
    if dedup:
        df = df.select("symbol", "ts").distinct()
    p = _prev(df.select("symbol", "ts"), ["ts"])
    expected = F.col("_prev") + F.expr(f"interval {minutes} minutes")
    return p.filter(F.col("_prev").isNotNull() & (F.col("ts") != expected)) \
        .select("symbol", expected.alias("expected"), F.col("ts").alias("actual"))


def quality_report(df: DataFrame, minutes: int) -> DataFrame:
    """Per symbol: expected and received rows, gaps, duplicates, completeness."""
    per_ts = df.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("_n"))
    p = _prev(per_ts, ["ts"])
    step = F.expr(f"interval {minutes} minutes")
    g = p.groupBy("symbol").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("_n").alias("received"),
        F.sum(F.col("_n") - 1).alias("duplicates"),
        F.count_if(F.col("_prev").isNotNull() & (F.col("ts") != F.col("_prev") + step)).alias("gaps"))
    span = F.unix_seconds("last_ts") - F.unix_seconds("first_ts")
    g = g.withColumn("expected", F.floor(span / (minutes * 60)) + 1)
    return g.withColumn("is_complete", (F.col("gaps") == 0) & (F.col("received") == F.col("expected")))


def dataset_audit(df: DataFrame, by: list[str], min_rows: int = 100) -> DataFrame:
    """Rows, range, missing, duplicate, negative and zero-volume shares, and a status."""
    price = ["open", "high", "low", "close"]
    per_key = df.groupBy(*by, "symbol", "ts").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(sum((F.col(x).isNull().cast("int") for x in price + ["volume"]), F.lit(0))).alias("_miss"),
        F.count_if((F.least(*price) < 0) | (F.col("volume") < 0)).alias("_neg"),
        F.count_if(F.col("volume") == 0).alias("_zero"))
    g = per_key.groupBy(*by).agg(
        F.sum("_n").alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"), F.sum("_miss").alias("_miss"), F.sum(F.col("_n") - 1).alias("duplicates"),
        F.sum("_neg").alias("negative_rows"), F.sum("_zero").alias("_zero"))
    g = g.withColumns({"missing_ratio": F.col("_miss") / (F.col("rows") * 5),
                       "duplicate_ratio": F.col("duplicates") / F.col("rows"),
                       "zero_volume_ratio": F.col("_zero") / F.col("rows")})
    status = (F.when(F.col("rows") < min_rows, "TOO_SHORT")
              .when((F.col("missing_ratio") > 0.1) | (F.col("duplicate_ratio") > 0.05), "LARGE_GAPS")
              .when((F.col("missing_ratio") > 0.01) | (F.col("duplicates") > 0), "MINOR_GAPS").otherwise("OK"))
    return g.withColumn("status", status).drop("_miss", "_zero")


def bar_sanity(df: DataFrame, minutes: int, max_move: float = 0.5) -> DataFrame:
    """Per symbol counts of gaps, bad prices, impossible ranges, extreme moves, zero volume."""
    one = dedup_last(df, ["symbol", "ts"], ["ts"])
    p = core_rows(blocked(one, 1).withColumns({"_prev": lag("ts"), "_pc": lag("close")}))
    step = F.unix_seconds("ts") - F.unix_seconds("_prev")
    move = F.abs(ieee_div(F.col("close"), F.col("_pc")) - 1)  # any move from 0 is extreme
    stats = p.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(step > 1.5 * minutes * 60).alias("gaps"),
        F.count_if(F.least("open", "high", "low", "close") <= 0).alias("bad_price"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"), F.count_if(F.col("high") < F.col("low")).alias("bad_range"),
        F.count_if(move > max_move).alias("extreme_moves"), F.count_if(F.col("volume") == 0).alias("zero_volume"))
    dup = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_rows"))
    return stats.join(dup, "symbol").withColumn("duplicates", F.col("_rows") - F.col("bars")).drop("_rows")


def file_integrity(df: DataFrame, minutes: int) -> DataFrame:
    """Per source file and symbol: range, rows, rows expected for the range, duplicates."""
    p = df.withColumn("file", F.input_file_name()).groupBy("file", "symbol", "ts").agg(F.count(F.lit(1)).alias("_n"))
    g = p.groupBy("file", "symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                                        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicates"))
    span = F.unix_seconds("last_ts") - F.unix_seconds("first_ts")
    return g.withColumn("expected_rows", F.floor(span / (minutes * 60)) + 1)


def content_fingerprint(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """First and last time, rows, and an order-free content hash (no row order is forced)."""
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                               F.count(F.lit(1)).alias("rows"),
                               F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(h).cast("string")), 256)
                               .alias("content_hash"))


def coverage(df: DataFrame, cols: list[str], by: str = "symbol") -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c(x).isNotNull().cast("double")).alias(f"cov_{x}") for x in cols])


def missing_ranges(requested: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(done.select(*keys).distinct(), keys, "left_anti")


def catalog(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
                               F.count(F.lit(1)).alias("rows"))


def catalog_query(cat: DataFrame, start, end) -> DataFrame:
    """Entries whose range overlaps [start, end]."""
    return cat.filter((F.col("start_ts") <= F.lit(end).cast("timestamp")) &
                      (F.col("end_ts") >= F.lit(start).cast("timestamp")))


__all__ = [k for k in list(globals()) if not k.startswith("_")] + ["running"]
