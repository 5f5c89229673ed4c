"""Joins on time ranges without a nested loop.

Both sides are put into time buckets and joined on the bucket, then filtered
exactly.  The range side is copied into every bucket it touches, the point side
into one.  Buckets with many points are cut further, and only they: first into shorter stretches of time, then, where one stretch
is still full (many points at one instant), by a salt that copies the ranges of that stretch alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barlens.session import written

#: Points that a bucket of a key may have before it is cut.
MOST = 200_000


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def points_in_ranges(ranges: DataFrame, points: DataFrame, by: Sequence[str], start: str, end: str,
                     ts: str, *, bucket_seconds: int, how: str = "left", closed: str = "right",
                     most: int = MOST) -> DataFrame:
    """Every (range, point) pair with equal ``by`` and the point inside the range.

    closed='right': start < ts <= end; 'left': start <= ts < end; 'both'.
    ``how='left'`` keeps ranges without points (their point columns are NULL).
    Points per (key, bucket) are counted first, with partial sums before the shuffle; there are at most points / ``most`` full buckets.
    """
    by = list(by)
    width = bucket_seconds * 1_000_000
    r = written(ranges.withColumn("_rid", F.monotonically_increasing_id()), "ranges")
    p = points.withColumn("_b", _bucket(F.col(ts), bucket_seconds))
    full = p.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    full = written(full.select(*by, "_b", F.ceil(F.col("_n") / F.lit(most)).cast("long").alias("_cuts")), "full")
    on = by + ["_b"]
    split = not full.isEmpty()

    def stretch(t: Column) -> Column:
        """Which stretch of its bucket a time lies in; times before or behind the bucket count to its edges."""
        inside = F.unix_micros(t) - F.col("_b") * width
        return F.greatest(F.lit(0), F.least(F.floor(inside * F.col("_cuts") / width).cast("long"), F.col("_cuts") - 1))

    rb = r.withColumn("_b", F.explode(F.sequence(
        _bucket(F.col(start), bucket_seconds), _bucket(F.greatest(F.col(start), F.col(end)), bucket_seconds))))
    if split:
        one = F.coalesce("_cuts", F.lit(1))
        p = p.join(full, on, "left").withColumn("_cuts", one).withColumn("_s", stretch(F.col(ts)))
        rb = rb.join(full, on, "left").withColumn("_cuts", one).withColumn(
            "_s", F.explode(F.sequence(stretch(F.col(start)), stretch(F.greatest(F.col(start), F.col(end))))))
        on = on + ["_s"]
        packed = p.filter("_cuts > 1").groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
        packed = written(packed.select(*on, F.ceil(F.col("_n") / F.lit(most)).cast("long").alias("_salts")), "packed")
        salts = F.coalesce("_salts", F.lit(1))
        p = p.join(packed, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*points.columns), salts)).drop("_salts", "_cuts")
        rb = rb.join(packed, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts", "_cuts")
        on = on + ["_salt"]
    t, lo, hi = F.col(ts), F.col(start), F.col(end)
    inside = {"right": (t > lo) & (t <= hi), "left": (t >= lo) & (t < hi),
              "both": (t >= lo) & (t <= hi)}[closed]
    hit = rb.join(p, on).filter(inside).drop(*[x for x in on if x not in by])
    if how != "left":
        return hit.drop("_rid")
    new = [x for x in points.columns if x not in by]
    miss = r.join(hit.select("_rid").distinct(), "_rid", "left_anti")
    types = {f.name: f.dataType for f in points.schema.fields}
    miss = miss.select(*ranges.columns, *[F.lit(None).cast(types[x]).alias(x) for x in new])
    return hit.select(*ranges.columns, *new).unionByName(miss)
