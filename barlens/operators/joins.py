"""Time-aware joins (J*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barlens.functions.core import c
from barlens.plans.hops import thinned
from barlens.plans.intervals import points_in_ranges
from barlens.plans.ordered import frame, running


def asof_join(base: DataFrame, overlay: DataFrame, by: list[str], values: dict[str, str], *,
              order: list[str] | None = None, tolerance: str | None = None,
              rows_per_slice: int | None = None) -> DataFrame:
    """Latest overlay row at or before each base row, per ``by``.

    Both sides are put into one ordered stream and the last overlay value is
    carried forward; hot keys are cut into ordered slices.  ``order`` names base
    columns that break ties in ``ts``.  Adds the values, and ``overlay_ts``.
    """
    order = order or []
    val = F.struct(F.col("ts").alias("overlay_ts"), *[F.col(k).alias(v) for k, v in values.items()])
    left = base.select(F.struct(*base.columns).alias("_row"), *by, "ts",
                       *[F.col(k).alias(f"_o{i}") for i, k in enumerate(order)])
    left = left.withColumn("_side", F.lit(1))
    right = overlay.select(*by, "ts", val.alias("_val")).withColumn("_side", F.lit(0))
    u = left.unionByName(right, allowMissingColumns=True)
    keys = ["ts", "_side"] + [f"_o{i}" for i in range(len(order))]
    r = running(u, by, keys, {"_last": ("last", F.col("_val"))}, rows_per_slice=rows_per_slice)
    r = r.filter(F.col("_side") == 1)
    hit = F.col("_last.overlay_ts").isNotNull()
    if tolerance:
        hit = hit & (F.col("ts") <= F.col("_last.overlay_ts") + F.expr(f"interval {tolerance}"))
    return r.select("_row.*", *[F.when(hit, F.col(f"_last.{v}")).alias(v) for v in values.values()],
                    F.when(hit, F.col("_last.overlay_ts")).alias("overlay_ts"))


def asof_fill(base: DataFrame, overlay: DataFrame, by: list[str], values: dict[str, str], max_age: str) -> DataFrame:
    """As-of value not older than ``max_age``, else 0."""
    j = asof_join(base, overlay, by, values, tolerance=max_age).drop("overlay_ts")
    return j.fillna(0.0, subset=list(values.values()))


def range_join_lookback(events: DataFrame, features: DataFrame, by: list[str], lookback: str, seconds: int) -> DataFrame:
    """Feature rows in (t - lookback, t] of each event; events without any are kept."""
    ev = events.withColumn("_from", F.col("ts") - F.expr(f"interval {lookback}")).withColumnRenamed("ts", "event_ts")
    ft = features.withColumnRenamed("ts", "feature_ts")
    return points_in_ranges(ev, ft, by, "_from", "event_ts", "feature_ts", bucket_seconds=seconds).drop("_from").withColumnRenamed("event_ts", "ts")


def event_window_sum(positions: DataFrame, events: DataFrame, by: list[str], pos_id: str, entry: str, exit_: str,
                     value: str, out: str) -> DataFrame:
    """Sum and count of event values in (entry, exit] per position.

    One ordered stream holds the events and the two ends of every position; the
    sum is the difference of two running sums, so nothing is multiplied.
    """
    ev = events.select(*by, "ts", F.col(value).alias("_v"), F.lit(0).alias("_k"), F.lit(None).cast(
        positions.schema[pos_id].dataType).alias(pos_id))
    ends = positions.select(*by, pos_id, F.explode(F.array(
        F.struct(F.col(entry).alias("ts"), F.lit(1).alias("_k")),
        F.struct(F.col(exit_).alias("ts"), F.lit(2).alias("_k")))).alias("_e")) \
        .select(*by, "_e.ts", F.lit(None).cast("double").alias("_v"), "_e._k", pos_id)
    u = ev.unionByName(ends)
    r = running(u, by, ["ts", "_k", pos_id], {"_cs": ("sum", F.col("_v")), "_cn": ("count", F.col("_v"))})
    sign = F.when(F.col("_k") == 2, 1).otherwise(-1)
    g = r.filter(F.col("_k") > 0).groupBy(*by, pos_id).agg(
        F.sum(sign * F.coalesce("_cs", F.lit(0.0))).alias(out), F.sum(sign * F.col("_cn")).alias(f"{out}_n"))
    return positions.join(g, [*by, pos_id])


def align_features_labels(features: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on labels that occur once; a key with several labels has no truth and is left out."""
    return features.join(labels.join(_single(labels, keys), keys, "left_semi"), keys)


def _single(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 1).drop("_n")


def join_audit(features: DataFrame, labels: DataFrame, keys: list[str], valid: str, label_ts: str) -> DataFrame:
    """Counts of unmatched, invalid and purged rows of a feature/label join."""
    lv = labels.withColumn("_ok", F.col(valid) == "VALID")
    f = features.select(*keys).withColumn("_f", F.lit(1))
    l = lv.select(*keys, "_ok", label_ts)
    j = f.join(l.filter("_ok"), keys, "full")
    m = F.col("_f").isNotNull() & F.col("_ok").isNotNull()
    a = j.agg(F.count_if(m).alias("matched_rows"), F.count_if(F.col("_f").isNotNull() & F.col("_ok").isNull()).alias("unmatched_features"),
              F.count_if(F.col("_f").isNull()).alias("unmatched_labels"),
              F.count_if(m & (F.col("ts") >= F.col(label_ts))).alias("purge_violations"))
    b = lv.agg(F.count_if(~F.col("_ok")).alias("invalid_labels"))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def seen_keys(df: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ledger.select(*keys).distinct(), keys, "left_semi")


def unseen_keys(df: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ledger.select(*keys).distinct(), keys, "left_anti")


def thin_by_min_gap(signals: DataFrame, by: list[str], gap: float, *, order: str = "ts",
                    rows_per_chunk: int = 200_000) -> DataFrame:
    """Greedy thinning: keep a signal if it is at least ``gap`` after the last kept one.

    ``gap`` is in seconds for timestamps, else in units of ``order``.  See ``plans.hops``: chains of kept rows are followed by doubling.
    """
    return thinned(signals, by, order, gap, rows_per_chunk=rows_per_chunk)[0]


def forward_path(df: DataFrame, h: int, cols: tuple[str, ...] = ("high", "low", "close"), out: str = "path") -> DataFrame:
    """The next ``h`` bars as an array of structs (blocked table with that lookahead)."""
    return df.withColumn(out, F.collect_list(F.struct(*cols)).over(frame(start=1, end=h)))


def overlap_count(positions: DataFrame, by: list[str], entry: str, exit_: str) -> DataFrame:
    """Open positions after each event time; an exit at T frees T.

    Events are summed per time first, so only distinct times are ordered.
    """
    e = positions.select(*by, F.explode(F.array(
        F.struct(F.col(entry).alias("ts"), F.lit(1).alias("d")),
        F.struct(F.col(exit_).alias("ts"), F.lit(-1).alias("d")))).alias("e")).select(*by, "e.ts", "e.d")
    g = e.groupBy(*by, "ts").agg(F.sum("d").alias("_d"))
    return running(g, by, ["ts"], {"open_positions": ("sum", F.col("_d"))}).drop("_d")


def mapping_join(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Select and rename (nested) fields from a map target -> source path."""
    return df.select(*[F.col(src).alias(dst) for dst, src in mapping.items()])


def attach_outcome(decisions: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    j = decisions.join(outcomes, key, "left")
    return j


__all__ = [k for k in list(globals()) if not k.startswith("_")] + ["Window", "c"]
