"""Readers and writers (IO*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlens.functions.core import c
from barlens.operators.quality import dedup_last
from barlens.operators.timegrid import ffill_resample
from barlens.session import settings

#: Times are stored as 64-bit numbers, so that footers hold their range.
WITH_RANGES = {"spark__sql__parquet__outputTimestampType": "TIMESTAMP_MICROS"}
BAR_COLUMNS = ["symbol", "interval", "ts", "open", "high", "low", "close", "volume"]


# ---- bars and overlays -------------------------------------------------------

def write_bars(df: DataFrame, path: str, mode: str = "append", checksums: bool = False) -> None:
    """Parquet by interval and month; a month of one interval is split by symbol hash into even files."""
    d = df.withColumn("month", F.date_format("ts", "yyyy-MM"))
    with settings(df.sparkSession, **WITH_RANGES):
        d.repartition("interval", "month", "symbol").write.mode(mode).partitionBy("interval", "month").parquet(path)
    if checksums:
        write_checksums(df.sparkSession, path)


def write_checksums(spark: SparkSession, path: str) -> None:
    """SHA-256 and size of every data file under ``path``, in a hidden folder beside them."""
    _digests(spark, path).write.mode("overwrite").json(f"{path.rstrip('/')}/_checksums")


def verify_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, state) with state ok, changed, missing or new."""
    want = spark.read.schema("file string, sha256 string, bytes long").json(f"{path.rstrip('/')}/_checksums").withColumnsRenamed({"sha256": "_w", "bytes": "_n"})
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("_w").isNull(), "new").when((F.col("sha256") == F.col("_w")) & (F.col("bytes") == F.col("_n")), "ok").otherwise("changed")
    return want.join(_digests(spark, path), "file", "full").select("file", state.alias("state"))


def _digests(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.parquet").load(path)
    return d.select(
        F.element_at(F.split("path", F.lit(path.rstrip("/").split("/")[-1] + "/")), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def read_bars(spark: SparkSession, path: str, interval: str, start, end, symbols: list[str] | None = None,
              order: list[str] | None = None) -> DataFrame:
    """Bars in [start, end): partitions pruned by month, rows by ts; the last duplicate stays."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    d = spark.read.parquet(path).filter((F.col("interval") == interval) & (F.col("month") >= F.date_format(lo, "yyyy-MM"))
                                        & (F.col("month") <= F.date_format(hi, "yyyy-MM")) & (F.col("ts") >= lo) & (F.col("ts") < hi))
    if symbols:
        d = d.filter(F.col("symbol").isin(symbols))
    keep = [x for x in BAR_COLUMNS if x in d.columns]
    return dedup_last(d.select(*keep, *(order or [])), ["symbol", "interval", "ts"], order or ["ts"]).select(*keep)


def write_funding(df: DataFrame, path: str, mode: str = "append") -> None:
    d = df.withColumns({"year": F.year("ts"), "month": F.month("ts")})
    d.hint("rebalance", F.col("year"), F.col("month")).write.mode(mode).partitionBy("year", "month").parquet(path)


def read_funding_partitions(spark: SparkSession, path: str, start, end) -> DataFrame:
    """Rows in [start, end]; only the months of the range are opened."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    ym = F.col("year") * 12 + F.col("month")
    return spark.read.parquet(path).filter((ym >= F.year(lo) * 12 + F.month(lo)) & (ym <= F.year(hi) * 12 + F.month(hi))
                                           & (F.col("ts") >= lo) & (F.col("ts") <= hi)).drop("year", "month")


def read_funding(spark: SparkSession, path: str, start, end, value: str = "funding_rate", freq: str = "1 hour") -> DataFrame:
    """Last row per time, text to number, filled forward on a regular grid."""
    d = read_funding_partitions(spark, path, start, end)
    d = d.withColumn(value, F.expr(f"try_cast({value} as double)"))
    return ffill_resample(dedup_last(d.select("symbol", "ts", value), ["symbol", "ts"], ["ts", value]), freq)


def read_panel_files(spark: SparkSession, paths: dict[str, str], symbols: list[str] | None = None) -> DataFrame:
    """One file per field to a long table, of ``symbols`` or of all.

    A file is wide (ts and one column per symbol) or long (ts, symbol and the field, or a column ``value``).
    """
    out = None
    for field, path in paths.items():
        d = spark.read.parquet(path)
        if "symbol" in d.columns:
            lg = d.select("ts", "symbol", F.col(field if field in d.columns else "value").alias(field))
            lg = lg.filter(F.col("symbol").isin(symbols)) if symbols else lg
        else:
            lg = d.unpivot("ts", [s for s in d.columns if s != "ts" and (not symbols or s in symbols)], "symbol", field)
        lg = lg.filter(F.col(field).isNotNull())
        out = lg if out is None else out.join(lg, ["ts", "symbol"], "full")
    return out


# ---- ledgers and traces ---------------------------------------------------------

def ledger_key(*cols) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def append_jsonl_ledger(df: DataFrame, path: str, key_cols: list[str]) -> None:
    df.withColumn("key", ledger_key(*key_cols)).write.mode("append").json(path)


def read_jsonl_ledger(spark: SparkSession, path: str, schema: str, ts: str, max_age: str, now: Column, key: str) -> DataFrame:
    """Well-formed lines younger than ``max_age``, one per key (the newest)."""
    d = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    d = d.filter(F.col(key).isNotNull() & (F.col(ts) >= now - F.expr(f"interval {max_age}")))
    return dedup_last(d, [key], [ts])


def read_trace_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): parsed traces with exit after entry, and the other lines with a reason."""
    raw = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    ok = F.col("exit_ts") > F.col("entry_ts")
    bad = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(F.col("entry_ts").isNull() | F.col("exit_ts").isNull(), "missing_time") \
        .when(~ok, "exit_not_after_entry")
    tagged = raw.withColumn("reason", bad)
    return tagged.filter(F.col("reason").isNull()).drop("reason", "_corrupt_record"), tagged.filter(F.col("reason").isNotNull())


SIGNAL_SCHEMA = ("event_id string, alpha_name string, symbol string, ts timestamp, direction string, signal_value double, "
                 "entry_price double, atr double")


def read_signal_events_csv(spark: SparkSession, path: str, schema: str = SIGNAL_SCHEMA) -> DataFrame:
    """Fixed columns by name; a missing column or a bad value fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """Header CSV; ``order`` sorts a report (rows of a report are few, so one file is written)."""
    d = df.orderBy(*order).coalesce(1) if order else df
    d.write.mode("overwrite").option("header", True).csv(path)


# ---- outcome cache -----------------------------------------------------------------

def outcome_cache_write(df: DataFrame, path: str, keys: int = 1_000_000, group_bytes: int = 16 << 20) -> None:
    """Append by symbol, for point lookups: files are sorted by alpha and time and carry Bloom filters of the alphas.

    The adaptive planner splits a large symbol over as many tasks as its size asks for.  Row groups are small, so a lookup opens the
    one whose filter and time range fit; ``keys`` is the number of alphas a filter is made for.
    """
    d = df.hint("rebalance", F.col("symbol")).sortWithinPartitions("symbol", "alpha_id", "ts")
    with settings(df.sparkSession, **WITH_RANGES):
        (d.write.mode("append").partitionBy("symbol").option("parquet.bloom.filter.enabled#alpha_id", "true")
         .option("parquet.bloom.filter.expected.ndv#alpha_id", str(keys)).option("parquet.block.size", str(group_bytes)).parquet(path))


def outcome_cache_query(spark: SparkSession, path: str, alpha_id: str | None = None, symbol: str | None = None, where: str | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    if symbol:
        d = d.filter(F.col("symbol") == symbol)
    if alpha_id:
        d = d.filter(F.col("alpha_id") == alpha_id)
    return d.filter(where) if where else d


def outcome_cache_lookup(spark: SparkSession, path: str, alpha_id: str, symbol: str, ts) -> DataFrame:
    return outcome_cache_query(spark, path, alpha_id, symbol).filter(F.col("ts") == F.lit(ts).cast("timestamp"))


def outcome_cache_summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("net_r") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
                               F.avg("net_r").alias("avg_r"))


# ---- candles ---------------------------------------------------------------------------

def candles_between(df: DataFrame, symbol: str, start, end) -> DataFrame:
    return df.filter((F.col("symbol") == symbol) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def latest_candles(df: DataFrame, symbol: str, n: int) -> DataFrame:
    return df.filter(F.col("symbol") == symbol).orderBy(F.desc("ts")).limit(n)


def write_by_symbol(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by symbol and month, in order of time: what the footers' catalogue is made for."""
    d = df.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition("symbol", "month").sortWithinPartitions("symbol", "month", "ts")
    with settings(df.sparkSession, **WITH_RANGES):
        d.write.mode(mode).partitionBy("symbol", "month").parquet(path)


def upsert_candles(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones with the same key, as a view of two tables; ``sources.keyed.KeyedTable`` upserts a stored one."""
    u = existing.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return dedup_last(u, keys, ["_v"]).drop("_v")


def flatten_outcomes(df: DataFrame, sides: tuple[str, ...] = ("long", "short")) -> DataFrame:
    """Nested outcome structs to prefixed flat columns."""
    out = [F.col(x) for x in df.columns if x not in sides]
    for s in sides:
        out += [F.col(f"{s}.{f}").alias(f"{s}_{f}") for f in df.schema[s].dataType.names]
    return df.select(*out)


__all__ = [k for k in list(globals()) if not k.startswith("_")] + ["c"]
