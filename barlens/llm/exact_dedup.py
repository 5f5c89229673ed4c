"""Exact duplicates by sorting the contents themselves."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barlens.llm.common import WS, table, text_batches, written

#: Characters of a text that a splitter holds.
HEAD = 64
_RUNS = ("part int, row long, doc_id long, head long, text_sha256 string, starts boolean, edge string, is_first boolean, is_last boolean")


def normalised(text: Column) -> Column:
    """Runs of white space (blank, 9 to 13) become one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def _runs(batches):
    """One pass over a sorted partition: each row is compared in full with its neighbour and gets the id that heads its run.

    Keeps one text between batches.  Edge texts go along with the first and the last row of the partition only.
    """
    part, row = TaskContext.get().partitionId(), 0
    last_text = head = digest = held = None
    for batch in batches:
        texts, ids, shas = batch.column("norm"), batch.column("doc_id").to_pylist(), batch.column("sha").to_pylist()
        if not ids:
            continue
        same = [False] * len(ids)
        if len(ids) > 1:
            same[1:] = pc.equal(texts.slice(1), texts.slice(0, len(ids) - 1)).to_pylist()
        same[0] = last_text is not None and texts[0].as_py() == last_text
        out = {k: [] for k in ("part", "row", "doc_id", "head", "text_sha256", "starts", "edge", "is_first", "is_last")}
        if held is not None:
            for k in out:
                out[k].append(held[k])
        for i, doc in enumerate(ids):
            if not same[i]:
                head, digest = doc, shas[i]
            first = row == 0
            values = (part, row, doc, head, digest, not same[i], texts[i].as_py() if first else None, first, False)
            for k, v in zip(out, values):
                out[k].append(v)
            row += 1
        last_text = texts[len(ids) - 1].as_py()
        held = {k: v.pop() for k, v in out.items()}  # the last row so far waits: only the partition's last carries its text
        if out["row"]:
            yield _batch(out)
    if held is not None:
        held |= {"is_last": True, "edge": last_text}
        yield _batch({k: [v] for k, v in held.items()})


def _batch(out):
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def sorted_runs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, keep_id, text_sha256) per row of (doc_id, text).

    Sampled splitters range-partition the normalised texts together with the id, so equal texts lie next to each other and a
    text that holds a third of all rows is still spread over many tasks.  A splitter holds the text's first characters, its
    SHA-256 and the id, as whole texts would not fit the sample that the driver sorts; the sort goes on to the whole text.  Each task sorts externally (Spark's sort spills)
    and compares neighbours in full.  A run that crosses a border is joined by comparing the edge texts of neighbouring
    partitions: one small row per partition.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "norm", F.sha2(F.col("norm"), 256).alias("sha"), F.substring("norm", 1, HEAD).alias("begins"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(parts, "begins", "sha", "doc_id").sortWithinPartitions("begins", "sha", "norm", "doc_id")
    runs = written(rows.select("doc_id", "norm", "sha").mapInArrow(_runs, _RUNS), "sorted-runs")
    # one row per non-empty partition, in order; a partition continues the one before if their edge texts are equal
    first = runs.where("is_first").select("part", F.col("edge").alias("first_text"))
    last = runs.where("is_last").select("part", F.col("edge").alias("last_text"), F.col("head").alias("last_head"))
    whole = runs.where("is_first or is_last or starts").groupBy("part").agg(F.sum(F.col("starts").cast("int")).alias("n_runs"))
    edges = first.join(last, "part").join(whole, "part")
    order = W.orderBy("part")
    edges = edges.withColumn("goes_on", F.coalesce(F.lag("last_text").over(order) == F.col("first_text"), F.lit(False)))
    # where a border run begins: the last partition before that does not go on as one single run
    edges = edges.withColumn("start", F.when(~(F.col("goes_on") & (F.col("n_runs") == 1)), F.struct(F.col("last_head").alias("id"))))
    edges = edges.withColumn("run_head", F.last("start", True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    fix = edges.where("goes_on").select("part", "run_head")
    runs = runs.join(F.broadcast(fix), "part", "left")  # at most one row per partition
    # rows of the first run of a partition that goes on: their head is that partition's first id and they lie before the next start
    second = runs.where("starts and row > 0").groupBy("part").agg(F.min("row").alias("second"))
    runs = runs.join(F.broadcast(second), "part", "left")
    keep = F.when(F.col("run_head").isNotNull() & (F.col("second").isNull() | (F.col("row") < F.col("second"))), F.col("run_head.id")).otherwise(F.col("head"))
    return runs.select("part", "row", "doc_id", keep.alias("keep_id"), "text_sha256")


def exact_duplicates(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing white space runs by one blank; the smallest doc_id of equal texts stays.
    Null text counts as empty.  Where an id with the same text is repeated, one of its rows is kept.  A null id sorts first
    and then is the one that stays.  An empty table gives no rows; other columns are not read.
    """
    runs = sorted_runs(docs, parts)
    sizes = runs.groupBy("text_sha256", "keep_id").agg(F.count("*").alias("group_size"), F.min(F.struct("part", "row")).alias("_first"))
    sizes = sizes.select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep"), "group_size", "_first")
    out = runs.join(sizes, (runs["text_sha256"] == F.col("_sha")) & runs["keep_id"].eqNullSafe(F.col("_keep")))
    return out.select("doc_id", "keep_id", "group_size", (F.struct("part", "row") == F.col("_first")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one per text.

    Where rows repeat the id that stays with the same text (a shard read twice), the least of them by its columns stays; such
    rows are merged before they are shuffled, so any number of them is one row per task.
    """
    runs = sorted_runs(docs)
    first = runs.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = written(first.groupBy(F.col("keep_id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.count("*").alias("_times")), "kept-texts")

    def rows_of(some: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(some["_id"]) & (F.sha2(normalised(docs["text"]), 256) == some["_sha"])
        return docs.join(some, same, "left_semi")

    twice = kept.where("_times > 1")
    if twice.isEmpty():
        return rows_of(kept)
    one = rows_of(twice).groupBy("doc_id", F.sha2(normalised(F.col("text")), 256).alias("_sha")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return rows_of(kept.where("_times = 1")).unionByName(one.select("_row.*"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
