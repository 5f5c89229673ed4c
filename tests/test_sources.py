"""Footers as a source, point lookups, upserts in place."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlens.session import scratch_path
from barlens.sources import files as IO, footers as FT
from barlens.sources.keyed import KeyedTable


def files_of(df):
    return set(df.inputFiles())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def scanned_rows(df):
    """Rows that the scans of an executed plan put out."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if name.startswith("Scan"):
            found += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_footers_tell_ranges_without_rows(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("S"), F.col("id") % 2).alias("symbol"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("ts"), F.col("id").cast("double").alias("close"))
    path = str(tmp_path / "bars")
    IO.write_by_symbol(rows, path)
    g = FT.footers(spark, path, files_per_task=3)
    assert g.rdd.getNumPartitions() == -(-len(rows_of(spark.read.parquet(path).select(F.input_file_name()).distinct())) // 3)
    want = rows.groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.min("ts"), F.max("ts"), F.count(F.lit(1)))
    assert rows_of(FT.footer_catalog(g, ["symbol", "month"]).select("symbol", "month", "start_ts", "end_ts", "rows")) == rows_of(want)
    assert {r.state for r in FT.footer_integrity(g, 120).collect()} == {"full"} and {r.state for r in FT.footer_integrity(g, 60).collect()} == {"fewer"}
    assert {r.state for r in FT.footer_integrity(FT.footers(spark, path, column="none"), 60).collect()} == {"unknown"}
    IO.write_by_symbol(rows.withColumn("symbol", F.lit("S0")), path)  # other times of the same symbol in further files
    assert FT.footers(spark, path).agg(F.sum("rows")).first()[0] == 8000


def test_bytes_read_do_not_grow_with_rows(spark, tmp_path):
    for name, n in (("small", 1_000), ("large", 300_000)):
        spark.range(n).select(F.timestamp_seconds("id").alias("ts"), F.xxhash64("id").alias("x")).coalesce(1).write.parquet(str(tmp_path / name))
    small, large = (FT.footers(spark, str(tmp_path / n)).first() for n in ("small", "large"))
    assert large.file_bytes > 50 * small.file_bytes and (small.rows, large.rows) == (1_000, 300_000)
    sizes = []
    for r in (small, large):  # what a reader of the footer needs: its length stands at the end of the file
        with open(r.file.removeprefix("file://").removeprefix("file:"), "rb") as f:
            f.seek(-8, 2)
            sizes.append(int.from_bytes(f.read(4), "little"))
    assert sizes[1] < 2 * sizes[0]


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.range(60_000).select(F.format_string("alpha-%05d", F.col("id") % 600).alias("alpha_id"), F.concat(F.lit("K"), F.col("id") % 2).alias("symbol"),
                                    F.timestamp_seconds(F.floor(F.col("id") / 600) * 60).alias("ts"), F.rand(1).alias("net_r"), F.sha2(F.col("id").cast("string"), 256).alias("note"))
    IO.outcome_cache_write(df, path, keys=1000, group_bytes=200_000)
    groups = FT.footers(spark, path)
    most = groups.agg(F.max("rows")).first()[0]
    assert groups.count() >= 10
    hit = IO.outcome_cache_lookup(spark, path, "alpha-00122", "K0", "1970-01-01 00:07:00")
    assert len(hit.collect()) == 1 and scanned_rows(hit) <= most
    gone = IO.outcome_cache_lookup(spark, path, "alpha-00122x", "K0", "1970-01-01 00:07:00")  # between two alphas: only the filter can tell
    assert scanned_rows(gone) == 0


def day(n):
    return dt.datetime(2024, 1, n)


def test_upserts_touch_only_their_parts(spark):
    t = KeyedTable(spark, scratch_path(spark, "keyed"), ["symbol", "ts"], [], lambda: F.date_format("ts", "yyyy-MM-dd"))
    schema = "symbol string, ts timestamp, close double"
    first = [(s, day(d), float(d)) for s in "ab" for d in range(1, 9)]
    assert t.upsert(spark.createDataFrame(first, schema), "1")
    before = files_of(t.read())
    new = spark.createDataFrame([("a", day(3), 30.0), ("c", day(3), 31.0), ("a", day(20), 9.0)], schema)
    assert t.upsert(new, "2")
    want = {(s, d): v for s, d, v in first} | {("a", day(3)): 30.0, ("c", day(3)): 31.0, ("a", day(20)): 9.0}
    assert rows_of(t.read()) == sorted((s, d, v) for (s, d), v in want.items())
    after = files_of(t.read())
    assert {f for f in before if "2024-01-03" not in f} <= after and not {f for f in before if "2024-01-03" in f} & after
    assert not t.upsert(new, "2") and files_of(t.read()) == after  # a retried batch changes nothing


def test_upserts_by_order_keep_the_newest(spark):
    t = KeyedTable(spark, scratch_path(spark, "keyed"), ["k"], ["v"])
    for batch, rows in (("1", [(1, 5), (1, 7), (2, 1)]), ("2", [(1, 6), (3, 3)]), ("3", []), ("4", [(2, 1), (2, 9)])):
        t.upsert(spark.createDataFrame(rows, "k int, v int"), batch)
    assert rows_of(t.read()) == [(1, 7), (2, 9), (3, 3)]
    extra = KeyedTable(spark, t.path, ["k"], ["v"])
    extra.upsert(spark.createDataFrame([(None, 1)], "k int, v int"), "5")
    assert len(extra.read().collect()) == 4
