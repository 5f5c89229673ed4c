"""Time-ordered folds and splits in distinct-timestamp space (L8..L12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barlens.plans.ordered import running


def time_index(df: DataFrame, ts: str = "ts", out: str = "ti") -> DataFrame:
    """Position of each distinct timestamp (0-based).

    One row per distinct time, counted by month slices: the long table itself
    is neither sorted nor put into one task.
    """
    t = df.select(ts).distinct()
    return running(t, [], [ts], {out: ("count", F.lit(1))}, slice_col=F.date_trunc("month", ts)) \
        .withColumn(out, (F.col(out) - 1).cast("long"))


def with_time_index(df: DataFrame, ts: str = "ts", out: str = "ti") -> DataFrame:
    return df.join(time_index(df, ts, out), ts)


def equal_time_folds(df: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """``fold`` 0..n-1 of equal numbers of timestamps; the last takes the rest."""
    idx = time_index(df, ts)
    total = idx.agg(F.max("ti") + 1).scalar()
    size = F.greatest(F.floor(total / F.lit(n)), F.lit(1))
    return df.join(idx.select(ts, F.least(F.floor(F.col("ti") / size), F.lit(n - 1)).cast("int").alias("fold")), ts)


def walk_forward_folds(df: DataFrame, train_days: int, val_days: int, ts: str = "ts") -> DataFrame:
    """(row, fold, role) by calendar windows: the validation window steps by its own length.

    A row's folds follow from its time by arithmetic, so rows are only repeated
    for the folds that use them.
    """
    day = 86_400
    lo, hi = F.unix_seconds(df.select(F.min(ts)).scalar()), F.unix_seconds(df.select(F.max(ts)).scalar())
    n = F.floor((hi - lo - train_days * day) / F.lit(val_days * day))
    d = df.withColumns({"_off": F.unix_seconds(ts) - lo, "_n": n})
    first = F.greatest(F.lit(0), F.floor((F.col("_off") - train_days * day) / F.lit(val_days * day)) + 1)
    last = F.least(F.col("_n") - 1, F.floor(F.col("_off") / F.lit(val_days * day)))
    val = F.floor((F.col("_off") - train_days * day) / F.lit(val_days * day))
    train = F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)),
                                              lambda k: F.struct(k.cast("int").alias("fold"), F.lit("train").alias("role"))))
    vals = F.when((val >= 0) & (val < F.col("_n")), F.array(F.struct(val.cast("int").alias("fold"), F.lit("val").alias("role"))))
    empty = F.array().cast("array<struct<fold:int,role:string>>")
    return d.withColumn("_f", F.explode(F.concat(F.coalesce(train, empty), F.coalesce(vals, empty)))) \
        .select(*df.columns, "_f.fold", "_f.role")


def walk_forward_roles(df: DataFrame, train: int, test: int, purge: int, val_ratio: float = 0.5,
                       oos_ratio: float = 0.5, anchored: bool = True, ts: str = "ts") -> DataFrame:
    """(ts, ti, fold, role) with role train, val or oos and purge gaps in distinct-bar space.

    Built from the list of distinct timestamps; join it to rows on ``ts``.
    """
    idx = time_index(df, ts)
    n = idx.agg(F.max("ti") + 1).scalar()
    step = test + purge
    folds = F.floor((F.col("_n") - train - test) / F.lit(step)) + 1
    d = idx.withColumn("_n", n).filter(F.col("_n") >= train + test)
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), folds - 1)))
    k = F.col("fold")
    train_lo = F.lit(0) if anchored else k * step
    train_hi = train + k * step
    test_lo = train_hi + purge
    test_hi = F.least(test_lo + test, F.col("_n"))
    usable = F.greatest(F.lit(1), test_hi - test_lo - purge)
    val_n = F.greatest(F.lit(1), F.floor(usable * val_ratio / (val_ratio + oos_ratio)))
    oos_n = F.greatest(F.lit(1), usable - val_n)
    val_hi = F.least(test_lo + val_n, test_hi)
    oos_lo = F.least(val_hi + purge, F.col("_n"))
    oos_hi = F.least(oos_lo + oos_n, test_hi)
    t = F.col("ti")
    role = (F.when((t >= train_lo) & (t < F.least(train_hi, F.col("_n"))), "train")
            .when((t >= test_lo) & (t < val_hi), "val").when((t >= oos_lo) & (t < oos_hi), "oos"))
    return d.withColumn("role", F.when((test_lo < test_hi) & (oos_lo < oos_hi), role)) \
        .filter(F.col("role").isNotNull()).select(ts, "ti", F.col("fold").cast("int").alias("fold"), "role")


def purge_report(roles: DataFrame, required: int) -> DataFrame:
    """Distinct bars between train and val, and val and oos, per fold."""
    def edge(fn, role):
        return fn(F.when(F.col("role") == role, F.col("ti")))
    g = roles.groupBy("fold").agg(edge(F.max, "train").alias("_te"), edge(F.min, "val").alias("_vs"),
                                  edge(F.max, "val").alias("_ve"), edge(F.min, "oos").alias("_os"))
    g = g.withColumns({"purge_before_val": F.col("_vs") - F.col("_te") - 1, "purge_before_oos": F.col("_os") - F.col("_ve") - 1,
                       "embargo_distance": F.greatest(F.lit(0), F.least("_vs", "_os") - F.col("_te") - 1)})
    return g.withColumn("ok", (F.col("purge_before_val") >= required) & (F.col("purge_before_oos") >= required)) \
        .drop("_te", "_vs", "_ve", "_os")


def temporal_split(df: DataFrame, order: list[str], discovery: float = 0.6, validation: float = 0.2, rows_per_slice: int | None = None) -> DataFrame:
    """discovery / validation / holdout by row order (a total order, cut in range partitions of about ``rows_per_slice`` rows)."""
    p = running(df, [], order, {"_i": ("count", F.lit(1))}, rows_per_slice=rows_per_slice)
    n = df.select(F.count(F.lit(1))).scalar()
    a = F.floor(n * F.lit(discovery))
    b = a + F.floor(n * F.lit(validation))
    i = F.col("_i") - 1
    return p.withColumn("split", F.when(i < a, "discovery").when(i < b, "validation").otherwise("holdout")).drop("_i")


def purged_expanding_roles(df: DataFrame, n_folds: int, horizon: int, ts: str = "ts") -> DataFrame:
    """Expanding folds on unique times with a purge before and an embargo after each boundary."""
    idx = time_index(df, ts)
    n = idx.agg(F.max("ti") + 1).scalar()
    d = idx.withColumn("_n", n).withColumn("_b", F.floor(F.col("_n") / F.lit(n_folds + 1)))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    bound = (F.col("fold") + 1) * F.col("_b")
    purge = F.greatest(F.floor(F.col("_b") / 4), F.lit(2 * horizon))
    embargo = F.greatest(F.floor(F.col("_b") / 8), F.lit(2 * horizon))
    t = F.col("ti")
    role = F.when(t < bound - purge, "train").when(
        (t >= bound + embargo) & (t < F.least((F.col("fold") + 2) * F.col("_b"), F.col("_n"))), "val")
    return d.withColumn("role", role).filter(F.col("role").isNotNull()).select(ts, "ti", "fold", "role")


__all__ = [k for k in list(globals()) if not k.startswith("_")] + ["Window"]
