"""Parquet footers as a data source: one row per row group, with its range and its bytes, without reading a row.

    spark.dataSource.register(ParquetFooters)
    spark.read.format("parquet_footers").option("column", "ts").load(path)

A task reads the footers of some files.  A catalogue or an integrity report over them costs the same for files of a thousand
rows and of a billion.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = ("file string, row_group int, rows long, bytes long, compressed_bytes long, file_bytes long, low string, high string, nulls long, "
          "partition map<string,string>")
FILES_PER_TASK = 200


class Files(InputPartition):
    def __init__(self, names: Sequence[str]):
        self.names = list(names)


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path within it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return pafs.LocalFileSystem(), path


def _text(v) -> str | None:
    return None if v is None else v.isoformat(" ") if hasattr(v, "isoformat") else str(v)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], column: str, per_task: int):
        self.paths, self.column, self.per_task = paths, column, per_task

    def partitions(self) -> list[InputPartition]:
        return [Files(self.paths[i:i + self.per_task]) for i in range(0, len(self.paths), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            system, path = _system(name)
            size = system.get_file_info(path).size
            with system.open_input_file(path) as f:
                meta = pq.ParquetFile(f).metadata
            at = next((i for i in range(meta.num_columns) if meta.schema.column(i).path == self.column), None)
            keys = {k: unquote(v) for k, _, v in (part.partition("=") for part in path.split("/")[:-1] if "=" in part)}
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                stats = group.column(at).statistics if at is not None else None
                known = stats is not None and stats.has_min_max
                yield (name, g, group.num_rows, group.total_byte_size, sum(group.column(i).total_compressed_size for i in range(meta.num_columns)), size,
                       _text(stats.min) if known else None, _text(stats.max) if known else None, stats.null_count if stats is not None and stats.has_null_count else None, keys)


class ParquetFooters(DataSource):
    """Options: ``files`` (newline-separated) and ``column``, whose range is told; ``per_task`` files a task."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([x for x in self.options.get("files", "").split("\n") if x], self.options.get("column", "ts"), int(self.options.get("per_task", FILES_PER_TASK)))


def footers(spark: SparkSession, path: str, column: str = "ts", files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """Row groups of all data files under a path, with low and high of ``column`` as text (of the type it has in the file)."""
    spark.dataSource.register(ParquetFooters)
    files = spark.read.parquet(path).inputFiles()  # Spark lists the folders; only names come here
    return spark.read.format("parquet_footers").option("files", "\n".join(files)).option("column", column).option("per_task", files_per_task).load()


def footer_catalog(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Range, rows, files and bytes per value of partition columns, from footers alone."""
    ts = F.col("low").cast("timestamp"), F.col("high").cast("timestamp")
    return groups.groupBy(*[F.col("partition")[k].alias(k) for k in by]).agg(
        F.min(ts[0]).alias("start_ts"), F.max(ts[1]).alias("end_ts"), F.sum("rows").alias("rows"), F.count_distinct("file").alias("files"), F.sum("bytes").alias("bytes"))


def footer_integrity(groups: DataFrame, minutes: int) -> DataFrame:
    """Per file: range, rows and the rows that a gapless range would have; ``state`` tells which files need their rows read at all.

    more: more rows than times, so rows repeat or several series share the file; fewer: times are missing; full: neither shows; unknown: no
    range in the footer.
    """
    g = groups.groupBy("file").agg(F.first("partition").alias("partition"), F.min(F.col("low").cast("timestamp")).alias("first_ts"), F.max(F.col("high").cast("timestamp")).alias("last_ts"),
                                                F.sum("rows").alias("rows"))
    g = g.withColumn("expected_rows", F.floor((F.unix_seconds("last_ts") - F.unix_seconds("first_ts")) / (minutes * 60)) + 1)
    e = F.col("expected_rows")
    return g.withColumn("state", F.when(e.isNull(), "unknown").when(F.col("rows") > e, "more").when(F.col("rows") < e, "fewer").otherwise("full"))


__all__ = ["ParquetFooters", "footers", "footer_catalog", "footer_integrity"]
