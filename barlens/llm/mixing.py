"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from barlens.llm.common import n_words, written

#: Fixed values of the default mix: weights of the sources in code-point order, repeating; times a text may be used.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size, n_docs, target): the words each source shall give.

    ``share`` of all words is dealt by weight; a target stops at ``max_epochs`` times its source's size and the excess is
    reshared by weight.  Solved in one pass: sources in the order of cap / weight reach their cap first, so prefix sums of
    caps and weights say which do, and the level of the others is what is left over their weights.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = (per.withColumn("rank", F.row_number().over(order) - 1)
           .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
           .withColumn("cap", F.col("source_size") * F.lit(max_epochs)))
    by_cap = W.orderBy(F.col("cap") / F.col("w"), "rank")
    before, every = by_cap.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = (per.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
           .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
           .withColumn("full", F.col("cap") / F.col("w") <= F.col("left") / F.col("w_left")))
    # all sources that are not full share one level: the first of them in cap order has it
    first = W.partitionBy("full").orderBy(F.col("cap") / F.col("w"), "rank")
    per = per.withColumn("level", F.first(F.col("left") / F.col("w_left")).over(first))
    return per.select("source", "source_size", "n_docs", "rank",
                      F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"), "budget")


def mix(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, salt: str = "mix",
        rows_per_task: int = 20_000) -> DataFrame:
    """Adds source_size, target, copies and taken to (doc_id, source, size, ...).

    Documents of a source stand in a shuffled order (md5 of id and salt).  Copy e of a document finishes at
    (e * source_size + words up to and with it) / target.  All copies are range-sorted by finish time and taken while the
    running sum of words stays within the budget, so every source is served in proportion to its target, and a text is
    used again only when its source has been used up.  Reruns agree: nothing depends on partitions.

    No source is one task: a source is cut into blocks by the leading digits of the shuffle key and block totals carry
    the running sum over; the global order is a range partitioning whose partition totals do the same.
    Null text has size 0; a null source is a source of its own, the last; sources without words have target 0; documents of
    size 0 are never taken; an empty table gives no rows; equal ids are ordered by size.  Other columns are carried along.
    """
    docs = written(sizes.withColumn("_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + salt)))), "mix-sizes")
    src = written(source_targets(docs, weights, max_epochs, share), "mix-sources")
    n = src.agg(F.sum("n_docs")).first()[0] or 0
    digits = 0
    while n > rows_per_task * 16 ** digits:
        digits += 1
    docs = docs.withColumn("_block", F.substring("_key", 1, digits))
    same = docs["source"].eqNullSafe(F.col("_src"))
    totals = docs.groupBy("source", "_block").agg(F.sum("size").alias("_n"))
    totals = totals.select(F.col("source").alias("_src"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(
        W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    run = W.partitionBy("source", "_block").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    docs = docs.withColumn("_in", F.sum("size").over(run))
    docs = docs.join(totals, same & (docs["_block"] == F.col("_b")), "left").drop("_src", "_b")
    src = src.withColumnRenamed("source", "_src")
    docs = docs.join(src, docs["source"].eqNullSafe(src["_src"]), "left").drop("_src")
    docs = written(docs.withColumn("_cum", F.col("_in") + F.col("_off")).drop("_in", "_off", "_block"), "mix-docs")

    def finish(e):
        return (F.lit(e) * F.col("source_size") + F.col("_cum")) / F.col("target")

    tie = ["_finish", "rank", "_key", "doc_id", "size"]
    copies = docs.where("size > 0").select("size", "rank", "_key", "doc_id", "budget", F.explode(F.array(*[finish(e) for e in range(max_epochs)])).alias("_finish"))
    parts = max(2, -(-n * max_epochs // (10 * rows_per_task)))
    line = written(copies.repartitionByRange(parts, *tie).withColumn("_part", F.spark_partition_id()), "mix-line")
    before = line.groupBy("_part").agg(F.sum("size").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(
        W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    line = line.join(before, "_part").withColumn("_run", F.col("_off") + F.sum("size").over(
        W.partitionBy("_part").orderBy(*tie).rowsBetween(W.unboundedPreceding, 0)))
    last = line.where("_run <= budget").agg(F.max(F.struct(*tie))).first()[0]
    if last is None:
        taken = F.lit(0).cast("int")
    else:
        spot = F.struct(*[F.lit(last[c]).cast(docs.schema[c].dataType if c in docs.columns else "double").alias(c) for c in tie])
        taken = reduce(lambda a, b: a + b, [
            F.when((F.col("size") > 0) & (F.struct(finish(e).alias("_finish"), *tie[1:]) <= spot), 1).otherwise(0) for e in range(max_epochs)])
    return docs.withColumn("copies", taken).withColumn("taken", F.col("copies") * F.col("size")).drop("_key", "_cum", "rank", "budget", "n_docs")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Weigh every document: doc_id, source, size, source_size, target, copies, taken."""
    return mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), **options)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as the mix takes it.

    Rows are matched by id, source and a hash of the text; repeated rows are weighed one by one and then share the
    number of copies of the first, so that no join multiplies them.
    """
    key = [F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("_text")]
    w = mix(docs.select(*key, n_words(F.col("text")).alias("size")), **options)
    w = w.where("copies > 0").groupBy("doc_id", "source", "_text").agg(F.max("copies").alias("_copies"))
    w = w.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("_text").alias("_t"), "_copies")
    on = docs["doc_id"].eqNullSafe(w["_id"]) & docs["source"].eqNullSafe(w["_src"]) & (F.xxhash64(docs["text"]) == w["_t"])
    return docs.join(w, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def op10_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(concat(doc_id, ':mix')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST(rank % 3 + 1 AS INT)] AS w, source_size * 3 AS cap FROM s),
p AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS budget,
             (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE AS remains,
             sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left
      FROM w WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap / w <= remains / w_left AS is_full FROM p),
t AS (SELECT *, CASE WHEN is_full THEN cap::DOUBLE
                ELSE first_value(remains / w_left) OVER (PARTITION BY is_full ORDER BY cap / w, rank) * w END AS target FROM f),
c AS (SELECT d.*, t.source_size, t.target, t.rank, t.budget, sum(d.size) OVER (PARTITION BY t.rank ORDER BY k, doc_id, d.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT doc_id, size, budget, rank, k, (e * source_size + cum)::DOUBLE / target AS fin
      FROM c, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY fin, rank, k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM x),
g AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE run <= budget GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(g.taken, 0) AS taken FROM c LEFT JOIN g USING (doc_id)
"""
