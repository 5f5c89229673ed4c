"""Tables the library works on, derived from the Parquet files of a folder.

No market data ships with the test folder, so bars, overlays and trades are
plain SQL-expressible derivations of its tables (see README).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barlens.functions.core import div, no_nan
from barlens.session import configure

BENCH = "S00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; zone-less timestamps are read as UTC, NaN becomes NULL."""
    configure(spark)
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    out = []
    for f in df.schema.fields:
        x = F.col(f.name)
        if isinstance(f.dataType, T.TimestampNTZType):
            x = x.cast("timestamp")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = no_nan(x)
        out.append(x.alias(f.name))
    return df.select(*out)


def ticks_from(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("S"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("symbol"),
        "ts", "event_id", F.col("value").alias("price"),
        (F.lit(1) + F.col("user_id") % 7).cast("double").alias("size"),
        F.when(F.col("event_type").isin("click", "view", "signup"), "buy").otherwise("sell").alias("side"),
        F.get_json_object("props", "$.k").cast("long").alias("k"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_from(load(spark, sf_dir, "events"))


# fixed values: microseconds per unit
_UNIT = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def freq_micros(freq: str) -> int:
    n, unit = freq.split()
    return int(n) * _UNIT[unit.rstrip("s")]


def bucket(ts: str | Column, freq: str) -> Column:
    """Start of the epoch-aligned bucket; plain arithmetic, so it may be used more than once."""
    step = freq_micros(freq)
    us = F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(step)))


def bucket_ceil(ts: str | Column, freq: str) -> Column:
    step = freq_micros(freq)
    us = F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
    return F.timestamp_micros(us + F.pmod(-us, F.lit(step)))


def bars_of(t: DataFrame, freq: str) -> DataFrame:
    """Ticks to bars; (ts, event_id) orders trades inside a bucket."""
    at = F.struct("ts", "event_id")
    g = t.groupBy("symbol", bucket("ts", freq).alias("_w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("size").alias("volume"),
        F.sum(F.col("price") * F.col("size")).alias("quote_volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.when(F.col("side") == "buy", F.col("size")).otherwise(0.0)).alias("taker_buy_volume"))
    return g.select("symbol", F.col("_w").alias("ts"), *[x for x in g.columns if x not in ("symbol", "_w")])


def bars(spark: SparkSession, sf_dir: str, freq: str = "4 hours") -> DataFrame:
    return bars_of(ticks(spark, sf_dir), freq)


def bars_1d_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily history: one symbol per order priority, price = order total."""
    o = load(spark, sf_dir, "orders")
    at = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy(F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("symbol"),
                     F.date_trunc("day", "o_orderdate").alias("ts")).agg(
        F.min_by("o_totalprice", at).alias("open"), F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", at).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.groupBy("symbol", bucket("ts", "8 hours").alias("ts")).agg(
        ((F.avg("price") - 100) / 1e6).alias("rate"))


def open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.groupBy("symbol", bucket("ts", "1 hour").alias("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))


def premium_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price minus mid price of the hour."""
    t = ticks(spark, sf_dir)
    return t.groupBy("symbol", bucket("ts", "1 hour").alias("ts")).agg(
        (F.avg("price") - (F.max("price") + F.min("price")) / 2).alias("value"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: order lines with their order."""
    li = load(spark, sf_dir, "lineitem")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    hour = F.col("l_partkey") % 24
    q = F.col("l_quantity").cast("int")
    opened = F.timestamp_add("HOUR", hour, F.col("o_orderdate"))
    closed = F.timestamp_add("HOUR", (F.col("l_partkey") * 7) % 24, F.col("l_shipdate"))
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_id"),
        F.concat(F.lit("K"), F.lpad((F.col("l_suppkey") % 25).cast("string"), 2, "0")).alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "SHORT").otherwise("LONG").alias("direction"),
        F.element_at(F.array(F.lit("SWING"), F.lit("SCALP"), F.lit("AGGRESSIVE_SCALP")),
                     (F.col("l_linenumber") % 3 + 1).cast("int")).alias("mode"),
        F.when(F.col("l_linestatus") == "O", "1h").otherwise("4h").alias("interval"),
        F.when(F.col("o_orderstatus") == "F", "TREND").when(F.col("o_orderstatus") == "O", "RANGE")
        .otherwise("TRANSITION").alias("regime"),
        F.substring("o_orderpriority", 3, 20).alias("source"),
        F.when(q % 4 == 0, "HIT_SL").when(q % 4 == 1, "HIT_TP").when(q % 4 == 2, "TIME_STOP")
        .otherwise("EARLY_STALE_EXIT").alias("close_reason"),
        (F.col("l_quantity") * 2).alias("confidence"),
        F.round((F.col("l_discount") - F.col("l_tax")) * 10, 4).alias("realized_r"),
        opened.alias("opened_at"), F.greatest(opened, closed).alias("closed_at"),
        F.when(F.col("l_linestatus") == "O", 60.0).otherwise(240.0).alias("interval_minutes"),
        (F.lit(1) + F.col("l_suppkey") % 40).cast("double").alias("expected_candles"),
        (F.col("l_extendedprice") / 1000).alias("notional_k"),
        F.col("l_tax").alias("fee_r"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary predictions with folds: y = quality, p from the id."""
    l = load(spark, sf_dir, "labels")
    return l.select(
        "doc_id", F.col("quality").cast("int").alias("y"),
        ((F.col("doc_id") * 37 % 100) / 100.0).alias("p"),
        (F.col("doc_id") % 5).cast("int").alias("fold"),
        ((F.col("doc_id") * 13 % 41 - 20) / 10.0).alias("realized_r"),
        F.col("toxic").cast("int").alias("y2"))
