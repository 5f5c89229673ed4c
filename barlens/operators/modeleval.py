"""Model evaluation, calibration and drift (C*)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.functions.core import c, div
from barlens.operators.trades import share, threshold_sweep  # noqa: F401  (C21)
from barlens.plans.ordered import running


def confidence_bins(df: DataFrame, conf: str, correct: str, n: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Equal-width bins on [0, 1], last one closed; an empty bin shows its middle."""
    keys = keys or []
    b = F.least(F.floor(F.col(conf) * n + 1e-12), F.lit(n - 1)).cast("int")
    g = df.withColumn("bin", b).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg(conf).alias("predicted"), F.avg(F.col(correct).cast("double")).alias("actual"))
    heads = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = heads.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    j = grid.join(g, [*keys, "bin"], "left")
    j = j.select(*keys, "bin", F.coalesce("count", F.lit(0)).alias("count"),
                 F.coalesce("predicted", (F.col("bin") + 0.5) / n).alias("predicted"), F.coalesce("actual", F.lit(0.0)).alias("actual"))
    return j.withColumn("deviation", F.col("predicted") - F.col("actual"))


# fixed values: bounds of the calibration status, and the factor that marks a degraded fold
ECE_GOOD, ECE_BAD, DEGRADED = 0.05, 0.15, 1.5


def calibration_error(bins: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Weighted and largest deviation (ECE, MCE) and a status."""
    keys = keys or []
    d = F.abs("deviation")
    g = bins.groupBy(*keys).agg(div(F.sum(d * F.col("count")), F.sum("count")).alias("ece"),
                                F.max(F.when(F.col("count") > 0, d)).alias("mce"), F.sum("count").alias("n"))
    e = F.col("ece")
    return g.withColumn("status", F.when(e < ECE_GOOD, "CALIBRATED").when(e < ECE_BAD, "UNCALIBRATED").otherwise("UNRELIABLE"))


def brier(df: DataFrame, probs: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Mean squared distance of a probability array to the one-hot label."""
    y = F.col(label)
    sq = F.aggregate(F.transform(F.col(probs), lambda p, i: F.pow(p - F.when(i == y, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, b: a + b)
    return df.groupBy(*(keys or [])).agg(F.avg(sq).alias("brier"))


def fold_degradation(ece: DataFrame, key: str) -> DataFrame:
    """Folds whose ECE exceeds the mean by a factor (one row per fold)."""
    base = ece.select(F.avg("ece")).scalar()
    return ece.withColumns({"baseline_ece": base, "ratio": div(F.col("ece"), base), "degraded": F.col("ece") > base * DEGRADED})


def platt_fit(df: DataFrame, score: str, label: str):
    v = VectorAssembler(inputCols=[score], outputCol="_f")
    m = LogisticRegression(featuresCol="_f", labelCol=label, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_raw").fit(v.transform(df))

    def predict(x: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        return m.transform(v.transform(x)).withColumn("calibrated", vector_to_array("_p")[1]).drop("_f", "_p", "_y", "_raw")
    return predict


def isotonic_fit(df: DataFrame, score: str, label: str):
    v = VectorAssembler(inputCols=[score], outputCol="_f")
    m = IsotonicRegression(featuresCol="_f", labelCol=label, predictionCol="calibrated").fit(v.transform(df))
    return lambda x: m.transform(v.transform(x)).drop("_f")


def classification_metrics(df: DataFrame, truth: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, macro F1 and rows from the confusion counts."""
    keys = keys or []
    cm = df.groupBy(*keys, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    e = F.explode(F.array(F.struct(F.col("t").alias("cls"), F.lit("t").alias("k")), F.struct(F.col("p").alias("cls"), F.lit("p").alias("k"))))
    x = cm.withColumn("e", e)
    hit = F.col("t") == F.col("p")
    per = x.groupBy(*keys, "e.cls").agg(F.sum(F.when((F.col("e.k") == "t") & hit, F.col("n")).otherwise(0)).alias("tp"),
                                        F.sum(F.when(F.col("e.k") == "t", F.col("n")).otherwise(0)).alias("nt"),
                                        F.sum(F.when(F.col("e.k") == "p", F.col("n")).otherwise(0)).alias("np"))
    f1 = F.coalesce(div(2.0 * F.col("tp"), F.col("nt") + F.col("np")), F.lit(0.0))
    return per.groupBy(*keys).agg(div(F.sum("tp"), F.sum("nt")).alias("accuracy"), F.avg(f1).alias("f1_macro"), F.sum("nt").alias("samples"))


def class_accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("samples"), share(F.col(truth) == F.col(pred)).alias("accuracy"))


def regression_metrics(df: DataFrame, truth: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    y, e = F.col(truth), F.col(truth) - F.col(pred)
    n = F.count(e).cast("double")
    return df.filter(e.isNotNull()).groupBy(*(keys or [])).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1.0 - div(F.sum(e * e), F.var_pop(y) * n)).alias("r2"), F.count(e).alias("samples"))


def regression_reliability(df: DataFrame, truth: str, pred: str, n: int = 5) -> DataFrame:
    """Bucket means over the prediction range, monotone flag and sign accuracy per bucket."""
    lo, hi = df.select(F.min(pred)).scalar(), df.select(F.max(pred)).scalar()
    p = F.col(pred)
    b = F.when(hi > lo, F.least(F.floor((p - lo) / F.when(hi > lo, hi - lo) * n), F.lit(n - 1))).otherwise(0).cast("int")
    g = df.withColumn("bucket", b).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean_predicted"), F.avg(truth).alias("mean_realized"),
        share(F.signum(p) == F.signum(F.col(truth))).alias("sign_accuracy"))
    prev = F.lag("mean_realized").over(Window.partitionBy().orderBy("bucket"))
    return g.withColumns({"error": F.abs(F.col("mean_predicted") - F.col("mean_realized")),
                          "monotone": F.coalesce(F.col("mean_realized") >= prev - 0.01, F.lit(True))})


def psi(expected: DataFrame, actual: DataFrame, col: str, n: int = 10, variant: str = "unit") -> DataFrame:
    """Population stability index.

    'unit': bins on [0, 1], shares clipped at 0.001.  'range': bins on the joint
    minimum and maximum, shares plus a small epsilon.
    """
    both = expected.select(F.col(col).alias("x"), F.lit(0).alias("s")).unionByName(actual.select(F.col(col).alias("x"), F.lit(1).alias("s")))
    both = both.filter(F.col("x").isNotNull())
    if variant == "unit":
        lo, w = F.lit(0.0), F.lit(1.0)
        both_in = both.withColumn("_in", (F.col("x") >= 0) & (F.col("x") <= 1))
    else:
        lo = both.select(F.min("x")).scalar()
        w = both.select(F.max("x")).scalar() - lo
        both_in = both.withColumn("_in", F.lit(True))
    b = F.least(F.floor((F.col("x") - lo) / F.when(w > 0, w) * n + 1e-12), F.lit(n - 1))
    g = both_in.withColumn("bin", F.when(F.col("_in"), F.coalesce(b, F.lit(0)))).groupBy("bin").agg(
        F.count(F.when(F.col("s") == 0, 1)).alias("e"), F.count(F.when(F.col("s") == 1, 1)).alias("a"))
    te, ta = g.select(F.sum("e")).scalar(), g.select(F.sum("a")).scalar()
    grid = expected.sparkSession.range(n).select(F.col("id").alias("bin"))
    j = grid.join(g, "bin", "left")
    pe, pa = F.coalesce(F.col("e"), F.lit(0)) / te, F.coalesce(F.col("a"), F.lit(0)) / ta
    if variant == "unit":
        pe, pa = (F.least(F.greatest(x, F.lit(0.001)), F.lit(1.0)) for x in (pe, pa))
    else:
        pe, pa = pe + 1e-6, pa + 1e-6
    return j.agg(F.sum((pa - pe) * F.log(pa / pe)).alias("psi"))


def ks_two_sample(a: DataFrame, b: DataFrame, col: str, rows_per_slice: int | None = None) -> DataFrame:
    """Largest gap of the two empirical distributions and its asymptotic p value.

    Equal values are counted first; the counts are accumulated in value order
    over slices, so no single task sorts the samples.
    """
    u = a.select(F.col(col).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(F.col(col).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))).filter(F.col("x").isNotNull())
    g = u.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    r = running(g, [], ["x"], {"ca": ("sum", F.col("a")), "cb": ("sum", F.col("b"))}, rows_per_slice=rows_per_slice)
    got = u.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()  # two row counts
    na, nb = F.lit(float(got["a"] or 0)), F.lit(float(got["b"] or 0))
    out = r.agg(F.max(F.abs(F.col("ca") / na - F.col("cb") / nb)).alias("ks"))
    en = F.sqrt(na * nb / (na + nb))
    lam = (en + 0.12 + 0.11 / en) * F.col("ks")
    p = reduce(lambda s, k: s + 2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam), range(1, 21), F.lit(0.0))
    return out.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def mean_drift(train: DataFrame, prod: DataFrame, cols: list[str], limit: float = 0.5) -> DataFrame:
    def means(df, name):
        one = df.agg(*[F.avg(x).alias(x) for x in cols])
        return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias(name)) for x in cols])).alias("r")).select("r.*")
    j = means(train, "train_mean").join(means(prod, "prod_mean"), "feature")
    d = F.col("prod_mean") - F.col("train_mean")
    rel = F.when(F.abs("train_mean") > 0.001, F.abs(d / F.when(F.abs("train_mean") > 0.001, F.col("train_mean")))).otherwise(F.abs(d))
    return j.withColumn("relative_change", rel).withColumn("drifted", F.col("relative_change") > limit)


def calibration_decay(current: DataFrame, baseline: DataFrame, key: str, warn: float = 1.25, alarm: float = 1.5) -> DataFrame:
    """ECE now against a baseline period and whether to recalibrate."""
    b = baseline.select(F.col(key).alias("_k"), F.col("ece").alias("baseline_ece"))
    j = current.join(b, F.col(key) == F.col("_k")).drop("_k")
    r = div(F.col("ece"), F.col("baseline_ece"))
    return j.withColumns({"ratio": r, "state": F.when(r >= alarm, "DECAYED").when(r >= warn, "WATCH").otherwise("STABLE"),
                          "recalibrate": F.coalesce(r >= alarm, F.lit(False))})


def label_quality(df: DataFrame, key: str, validity: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), share(F.col(validity) == "VALID").alias("valid_rate"),
                               share(F.col(validity) == "AMBIGUOUS").alias("ambiguous_rate"))


def importance_aggregate(df: DataFrame, feature: str, gain: str, fold: str, k: int = 10, noise: float = 0.1) -> DataFrame:
    """Mean and spread of gains over folds, rank, and a noise flag relative to the mean gain."""
    g = df.groupBy(feature).agg(F.avg(gain).alias("mean_gain"), F.stddev_pop(gain).alias("std_gain"), F.count_distinct(fold).alias("folds"))
    w = Window.partitionBy()
    g = g.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("mean_gain"), feature)), "_avg": F.avg("mean_gain").over(w)})
    return g.withColumns({"in_top_k": F.col("rank") <= k, "is_noise": F.col("mean_gain") < F.col("_avg") * noise}).drop("_avg")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def train_folds(df: DataFrame, roles: DataFrame, features: list[str], label: str, *, on: str = "ts", kind: str = "classifier",
                trees: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """Boosted trees per fold; predictions of the validation rows with their fold.

    Folds are a handful and are trained one after the other; each fit is a
    distributed job over its training rows.
    """
    folds = [r["fold"] for r in roles.select("fold").distinct().orderBy("fold").collect()]
    x = assemble(df, features)
    parts = []
    for f in folds:
        r = roles.filter(F.col("fold") == f)
        tr = x.join(r.filter("role = 'train'").select(on), on, "left_semi")
        va = x.join(r.filter("role = 'val'").select(on), on, "left_semi")
        est = GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed) if kind == "classifier" else \
            GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
        parts.append(est.fit(tr).transform(va).withColumn("fold", F.lit(f)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ensemble_agreement(preds: DataFrame, key: str, vote: str, threshold: float) -> DataFrame:
    """Share of models that vote the most common label per row."""
    v = preds.groupBy(key, vote).agg(F.count(F.lit(1)).alias("_n"))
    g = v.groupBy(key).agg(F.max_by(vote, F.struct(F.col("_n"), -F.col(vote))).alias("label"), (F.max("_n") / F.sum("_n")).alias("agreement"))
    return g.withColumn("accepted", F.col("agreement") >= threshold)


def group_ablation(df: DataFrame, roles: DataFrame, groups: dict[str, list[str]], label: str, **kw) -> DataFrame:
    """Accuracy without each feature group against all features."""
    every = [f for g in groups.values() for f in g]

    def acc(features, name):
        p = train_folds(df, roles, features, label, **kw)
        return p.agg(share(F.col("prediction") == F.col(label)).alias("accuracy")).withColumn("dropped", F.lit(name))

    full = acc(every, "none")
    out = full
    for name, cols in groups.items():
        out = out.unionByName(acc([f for f in every if f not in cols], name))
    base = full.select("accuracy").scalar()
    return out.withColumn("delta", F.col("accuracy") - base)


def overfit_gap(df: DataFrame, metric: Column) -> DataFrame:
    """Metric on train and validation rows per fold, their gap, and sign consistency."""
    g = df.groupBy("fold").agg(F.avg(F.when(F.col("role") == "train", metric)).alias("train"), F.avg(F.when(F.col("role") == "val", metric)).alias("val"))
    g = g.withColumn("gap", F.col("train") - F.col("val"))
    w = Window.partitionBy()
    same = F.greatest(F.sum(F.when(F.col("val") > 0, 1).otherwise(0)).over(w), F.sum(F.when(F.col("val") < 0, 1).otherwise(0)).over(w))
    return g.withColumn("sign_consistency", same / F.count(F.lit(1)).over(w))


def signals_from_predictions(df: DataFrame, threshold: float, stop: float, target: float) -> DataFrame:
    """Entry, side and levels where the predicted class is directional, sure enough and the ATR is sane."""
    from barlens.functions import trading as P
    ok = F.col("cls").isin(0, 1) & (F.col("prob") >= threshold) & (F.col("close") > 0) & (F.col("atr") > 0) & (F.col("atr") <= F.col("close") * 0.5)
    x = df.filter(ok).withColumn("side", F.when(F.col("cls") == 0, "LONG").otherwise("SHORT"))
    lv = P.stop_target_levels("close", "atr", F.lit(stop), F.lit(target))
    long = F.col("side") == "LONG"
    return x.withColumns({"stop_price": F.when(long, lv["long_stop"]).otherwise(lv["short_stop"]),
                          "target_price": F.when(long, lv["long_target"]).otherwise(lv["short_target"]), "initial_risk": F.col("atr") * stop})


def model_disagreement(a: Column, b: Column) -> Column:
    """Half the L1 distance of two probability arrays."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / 2.0


def recent_error(df: DataFrame, keys: list[str], order: list[str], err: str, n: int) -> DataFrame:
    """Mean absolute error of the last n rows, on blocks with overlapping edges."""
    from barlens.plans.ordered import blocked, core_rows
    b = blocked(df, n, keys=keys, order=order, unit=None)
    w = Window.partitionBy(*keys, "blk").orderBy("rn").rowsBetween(-(n - 1), 0)
    return core_rows(b.withColumn("recent_error", F.avg(F.abs(err)).over(w)))


def symbol_specialists(df: DataFrame, features: list[str], label: str, min_rows: int = 20, ridge: float = 1.0) -> DataFrame:
    """One linear model per symbol, fitted from per-symbol sums.

    The normal equations need only sums of products: rows are added up
    map-side, whatever the size of a symbol, and one small system per symbol is
    solved in a pandas function.
    """
    import numpy as np
    import pandas as pd
    cols = ["_one", *features]
    x = df.withColumn("_one", F.lit(1.0))
    prods = [F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    ys = [F.sum(F.col(a) * F.col(label)).alias(f"y{i}") for i, a in enumerate(cols)]
    g = x.dropna(subset=[*features, label]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *prods, *ys).filter(F.col("n") >= min_rows)
    k = len(cols)

    def solve(it):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                m = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                m[np.arange(1, k), np.arange(1, k)] += ridge
                out.append({"symbol": r["symbol"], "n": r["n"], "coef": np.linalg.solve(m, np.array([r[f"y{i}"] for i in range(k)])).tolist()})
            yield pd.DataFrame(out, columns=["symbol", "n", "coef"])

    return g.mapInPandas(solve, "symbol string, n bigint, coef array<double>")


def blend(df: DataFrame, specialists: DataFrame, features: list[str], global_score: str, weight: float = 0.5) -> DataFrame:
    """Specialist score where one exists, mixed with the global score."""
    j = df.join(specialists.select("symbol", "coef"), "symbol", "left")
    own = F.get("coef", F.lit(0))
    for i, f in enumerate(features, 1):
        own = own + F.get("coef", F.lit(i)) * F.col(f)
    return j.withColumn("blended", F.coalesce(own * weight + F.col(global_score) * (1.0 - weight), F.col(global_score))).drop("coef")


__all__ = [k for k in list(globals()) if not k.startswith("_")] + ["math", "c"]
