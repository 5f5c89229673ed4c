"""A table with one row per key that takes upserts in place: only the parts that a batch touches are written.

The table is Parquet in parts (a partition column).  An upsert reads the touched parts, merges, and replaces just these; files of other
parts keep their names.  A part is always one merged set of rows, so nothing piles up.  A log beside the data names the batches that
are in, so a batch that is tried again changes nothing; one that failed half way is merged again, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlens.operators.quality import dedup_last
from barlens.session import written

#: Parts of a table whose rows are spread by a hash of the key.
PARTS = 64


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], part: Callable[[], Column] | None = None):
        """``order``: of rows with one key the last stays, a newer batch going before an older one if ``order`` is empty.  ``part`` names
        the part of a row, by its own columns (a month, a symbol); a hash of the key unless given."""
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), list(keys), list(order)
        self.part = part or (lambda: F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("string"))

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        return self._stored().drop("_part")

    def _stored(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path).withColumn("_part", F.col("_part").cast("string"))

    def upsert(self, rows: DataFrame, batch: str) -> bool:
        """Merge a batch; False if the log says that it is in already."""
        if self._exists(f"{self.path}/_log/{batch}"):
            return False
        new = written(dedup_last(rows, self.keys, self.order or self.keys).withColumn("_part", self.part()), "upsert")
        touched = new.select("_part").distinct()
        merged = new.withColumn("_new", F.lit(1))
        if self._exists(f"{self.path}/_parts"):
            # the touched parts are a join with partition values, so the scan opens only their files
            old = self._stored().join(F.broadcast(touched) if self.parts_are_few(touched) else touched, "_part", "left_semi")
            merged = merged.unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
        merged = written(dedup_last(merged, self.keys, [*self.order, "_new"]).drop("_new"), "merged")
        (merged.hint("rebalance", F.col("_part")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(self.path))
        self.spark.range(1).write.mode("overwrite").json(f"{self.path}/_parts")
        touched.agg(F.count(F.lit(1)).alias("parts")).write.mode("overwrite").json(f"{self.path}/_log/{batch}")
        return True

    @staticmethod
    def parts_are_few(touched: DataFrame, most: int = 10_000) -> bool:
        """Checked before the names of touched parts are broadcast, which lets the scan skip all other files."""
        return touched.limit(most + 1).count() <= most


__all__ = ["KeyedTable"]
