"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlens.session import shared_dir

#: White space that separates words in every contract: blank and the controls 9 to 13.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]+"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the folder all executors share and read again: cuts lineage, survives lost executors.  ``options`` are the writer's.

    The shuffle files of the write are given back when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._written)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table."""
    return written(df, "cut")


def text_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Texts can be long: Arrow batches of few rows and bytes keep a Python worker's memory bounded.  Stricter settings stay."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def batches_of(spark: SparkSession, rows: int = 512, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes for what is written inside the block; stricter settings stay, and the session's own come back after it."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k) for k in names}
    asked = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    spark.conf.set(names[0], str(min(int(before[names[0]]), rows)))
    spark.conf.set(names[1], str(min(int(asked(before[names[1]])), int(asked(size)))))
    try:
        yield
    finally:
        for k in names:
            spark.conf.set(k, before[k])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_WS)).cast("long")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves the remainder ``part``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterable[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice have about ``most`` bytes; a longer text is a slice of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), the smallest reachable node.

    ``edges`` has long columns a and b.  Alternating stars: each round links every larger neighbour of a node, then every
    smaller one, to the smallest neighbour, until the edges no longer change; rounds grow with the logarithm of the longest
    path.  A node's neighbours are never gathered: each step is a minimum (partial sums before the shuffle) and a join,
    which the adaptive planner splits where a node is hot.  The driver sees a count and a checksum per round.
    Nodes without an edge to another node are not returned.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u go to the least of u and its neighbours
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its neighbours below go to the least of them
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                                 F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        old, e = e, cut(small.select("x.*").where("u <> v").distinct())
        discard(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point within {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(
        e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))


__all__ = ["WS", "NOT_WS", "written", "discard", "remove", "cut", "table", "n_words", "held_out", "byte_slices", "text_batches", "batches_of", "components"]
