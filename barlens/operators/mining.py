"""Rule mining over decile conditions (M*)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.functions.core import c, div
from barlens.plans.quantiles import exact_quantiles
from barlens.plans.vertical import ROWS_PER_SLICE, extended, vertical
from barlens.session import cut_lineage, written

# fixed values: decile ranges of the domain buckets, and the name parts that select a domain
DOMAINS = {
    "volatility": {"very_low": (1, 1), "low": (2, 3), "mid": (4, 7), "high": (8, 9), "very_high": (10, 10)},
    "regime": {"down": (1, 3), "range": (4, 7), "up": (8, 10)},
    "momentum": {"strong_bear": (1, 2), "weak_bear": (3, 4), "neutral": (5, 6), "weak_bull": (7, 8), "strong_bull": (9, 10)},
}
DOMAIN_WORDS = {"volatility": ("volatility", "atr"), "regime": ("regime",),
                "momentum": ("momentum", "return", "rsi", "roc", "strength")}


def domain_of(feature: str) -> str | None:
    low = feature.lower()
    return next((d for d, words in DOMAIN_WORDS.items() if any(w in low for w in words)), None)


def fit_deciles(df: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """Nine exact percentiles per feature; 9 numbers per feature are fetched."""
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    lg = df.select(F.explode(arr).alias("e")).select("e.*")
    q = exact_quantiles(lg, ["feature"], "x", {f"p{i}": i / 10 for i in range(1, 10)})
    got = {r["feature"]: [r[f"p{i}"] for i in range(1, 10)] for r in q.collect()}
    return {f: got.get(f, [0.0] * 9) for f in features}


def decile(x, cuts: list[float]) -> Column:
    """1..10; a value on a cut belongs to the lower decile."""
    x = c(x)
    n = sum((F.when(x > t, 1).otherwise(0) for t in cuts), F.lit(0))
    return F.when(x.isNotNull(), n + 1)


def bucketize(df: DataFrame, cuts: dict[str, list[float]], out: str = "conditions") -> DataFrame:
    """Sorted array of the condition names a row meets: its deciles and domain buckets."""
    names = []
    # deciles become columns first, so that the names do not repeat them
    df = df.withColumns({f"_dcl_{f}": decile(f, t) for f, t in cuts.items()})
    for f, t in cuts.items():
        dcl = F.col(f"_dcl_{f}")
        names.append(F.when(dcl.isNotNull(), F.concat(F.lit(f"{f}__d"), F.lpad(dcl.cast("string"), 2, "0"))))
        dom = domain_of(f)
        if dom:
            b = F
            for label, (lo, hi) in DOMAINS[dom].items():
                b = b.when((dcl >= lo) & (dcl <= hi), f"{f}__{label}")
            names.append(b.otherwise(None))
    return df.withColumn(out, F.sort_array(F.array_compact(F.array(*names)))).drop(*[f"_dcl_{f}" for f in cuts])


def condition_registry(df: DataFrame, min_support: float = 0.0, conditions: str = "conditions") -> DataFrame:
    n = df.select(F.count(F.lit(1))).scalar()
    g = df.select(F.explode(conditions).alias("condition")).groupBy("condition").agg(F.count(F.lit(1)).alias("support"))
    return g.filter(F.col("support") / n >= min_support)


def patterns(df: DataFrame, target: str, conditions: str = "conditions", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the same conditions (and ``by``) as one: rows ``_n``, rows with a target ``_k``, wins ``_w``, sum ``_s`` and sum of squares ``_q``.

    Rows are merged map-side and there are at most as many patterns as combinations of buckets, so no scan below multiplies or moves rows.
    """
    x = F.col(target).cast("double")
    g = df.groupBy(*by, F.col(conditions).alias("conditions")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(x).alias("_k"), F.count(F.when(x > 0, 1)).alias("_w"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    return written(g, "patterns")


def _totals(p: DataFrame):
    """Numbers of the whole table from its patterns, and the most conditions that a row has."""
    r = p.agg(*[F.sum(f"_{x}").alias(x) for x in "nksq"], F.max(F.size("conditions")).alias("width")).first()  # one row of five numbers
    t = {x: F.lit(float(r[x]) if r[x] is not None else None).cast("double") for x in "nksq"}
    t["n"] = F.coalesce(t["n"], F.lit(0.0))
    return t | {"m": div(t["s"], t["k"]), "width": max(r["width"] or 0, 0)}


def _score():
    k = F.sum("_k").cast("double")
    return [F.sum("_n").alias("support"), div(F.sum("_s"), k).alias("mean_r"), div(F.sum("_w").cast("double"), k).alias("win_rate"),
            F.sum("_k").alias("_k"), F.sum("_s").alias("_s")]


_SUMS = ("_n", "_k", "_w", "_s")


def level1_scan(df: DataFrame, target: str, min_support: float = 0.01, conditions: str = "conditions") -> DataFrame:
    return _level1(patterns(df, target, conditions), min_support)


def _level1(p: DataFrame, min_support: float) -> DataFrame:
    t = _totals(p)
    g = p.select(*_SUMS, F.explode("conditions").alias("condition")).groupBy("condition").agg(*_score())
    g = g.filter((F.col("support") >= F.ceil(t["n"] * F.lit(min_support))) & F.col("mean_r").isNotNull())
    return g.withColumns({"support_frac": F.col("support") / t["n"], "lift": F.coalesce(div(F.col("mean_r"), t["m"]), F.lit(0.0))}).drop("_k", "_s")


def pairs_of(conditions: str, width: int | None = None) -> Column:
    """All pairs of a row's conditions (a few per feature, so bounded by the columns).

    With a known ``width`` the pairs are spelled out, which stays inside
    generated code; otherwise array functions build them.
    """
    if width is None or width > 24:
        return F.expr(f"flatten(transform({conditions}, (a, i) -> transform(slice({conditions}, i + 2, size({conditions})), "
                      "b -> named_struct('a', a, 'b', b))))")
    at = [F.get(F.col(conditions), F.lit(i)) for i in range(width)]
    return F.array_compact(F.array(*[F.when(at[j].isNotNull(), F.struct(at[i].alias("a"), at[j].alias("b")))
                                     for i in range(width) for j in range(i + 1, width)]))


def triples_of(conditions: str, width: int) -> Column:
    """All triples of a row's conditions, in their order; spelled out while they are few."""
    if width > 9:
        n = f"size({conditions})"
        return F.expr(f"flatten(transform({conditions}, (a, i) -> flatten(transform(slice({conditions}, i + 2, {n}), (b, j) -> "
                      f"transform(slice({conditions}, i + j + 3, {n}), z -> named_struct('a', a, 'b', b, 'c', z))))))")
    at = [F.get(F.col(conditions), F.lit(i)) for i in range(width)]
    return F.array_compact(F.array(*[F.when(at[k].isNotNull(), F.struct(at[i].alias("a"), at[j].alias("b"), at[k].alias("c")))
                                     for i in range(width) for j in range(i + 1, width) for k in range(j + 1, width)]))


def _width(df: DataFrame, conditions: str) -> int:
    return df.agg(F.max(F.size(conditions))).first()[0] or 0


def level2_scan(df: DataFrame, target: str, min_support: float = 0.01, top_n: int | None = None, conditions: str = "conditions") -> DataFrame:
    """Support, mean, win rate, lift and IC of every pair; ``top_n`` asks for the best only.

    Pairs are formed inside a pattern and summed map-side, so what is shuffled is
    one row per pair and task.  The IC comes from the sums in closed form.
    """
    p = patterns(df, target, conditions)
    t = _totals(p)
    x = p.select(*_SUMS, F.explode(pairs_of("conditions", t["width"])).alias("p")).select(*_SUMS, "p.a", "p.b")
    g = x.groupBy("a", "b").agg(*_score())
    g = g.filter((F.col("support") >= F.ceil(t["n"] * F.lit(min_support))) & F.col("mean_r").isNotNull())
    k = t["k"].cast("double")
    mx, my = F.col("_k") / k, t["s"] / k
    cov = F.col("_s") / k - mx * my
    vx, vy = mx - mx * mx, t["q"] / k - my * my
    g = g.withColumns({"support_frac": F.col("support") / t["n"], "lift": F.coalesce(div(F.col("mean_r"), t["m"]), F.lit(0.0)),
                       "ic": F.coalesce(div(cov, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))), F.lit(0.0))})
    g = g.drop("_k", "_s")
    return g if top_n is None else g.orderBy(*_best_first("a", "b")).limit(top_n)


def _best_first(*names: str):
    """Best mean first; means that differ by rounding noise only are ordered by name."""
    return [F.desc(F.round("mean_r", 10)), *names]


def level3_scan(df: DataFrame, pairs: DataFrame, target: str, min_support: float = 0.01, beam: int | None = None, conditions: str = "conditions") -> DataFrame:
    """Third conditions that improve a pair; ``beam`` asks for the best pairs only.

    The sums of a triple are the same whichever of its conditions is the third one, so each is summed once, map-side;
    supported triples only meet the pairs.
    """
    p = patterns(df, target, conditions)
    t = _totals(p)
    best = pairs if beam is None else pairs.orderBy(*_best_first("a", "b")).limit(beam)
    best = best.select("a", "b", F.col("mean_r").alias("_base"))
    x = p.withColumn("conditions", F.array_distinct("conditions"))
    x = x.select(*_SUMS, F.explode(triples_of("conditions", t["width"])).alias("t")).groupBy("t").agg(*_score())
    x = x.filter(F.col("support") >= F.ceil(t["n"] * F.lit(min_support)))
    ways = F.array(*[F.struct(F.col(f"t.{a}").alias("a"), F.col(f"t.{b}").alias("b"), F.col(f"t.{z}").alias("third")) for a, b, z in ("abc", "acb", "bca")])
    g = x.withColumn("_way", F.explode(ways)).select("_way.*", "support", "mean_r", "win_rate").join(best, ["a", "b"])
    g = g.filter(F.col("mean_r") > F.col("_base") + 1e-10)
    return g.withColumns({"improvement": F.col("mean_r") - F.col("_base"), "lift": F.coalesce(div(F.col("mean_r"), t["m"]), F.lit(0.0))}).drop("_base")


def redundant_pairs(p: DataFrame, limit: float) -> DataFrame:
    """(a, b) of conditions whose correlation over the rows of ``patterns`` exceeds ``limit``, both ways round."""
    t = _totals(p)
    n = t["n"]
    pc = p.select("_n", F.explode(pairs_of("conditions", t["width"])).alias("p")).groupBy("p.a", "p.b").agg(F.sum("_n").alias("_ab"))
    reg = p.select("_n", F.explode("conditions").alias("condition")).groupBy("condition").agg(F.sum("_n").alias("support"))
    pc = pc.join(reg.select(F.col("condition").alias("a"), F.col("support").alias("_na")), "a") \
        .join(reg.select(F.col("condition").alias("b"), F.col("support").alias("_nb")), "b")
    phi = div(F.col("_ab") * n - F.col("_na") * F.col("_nb").cast("double"),
              F.sqrt(F.col("_na").cast("double") * (n - F.col("_na"))) * F.sqrt(F.col("_nb").cast("double") * (n - F.col("_nb"))))
    near = pc.filter(phi > limit)
    return near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def beam_search(df: DataFrame, target: str, beam: int = 50, depth: int = 3, min_support: float = 0.01,
                conditions: str = "conditions", redundancy: float = 0.95, rows_per_slice: int | None = None) -> DataFrame:
    """Grow rules one condition per round, keeping the best ``beam`` of each round.

    A condition that correlates above ``redundancy`` with one already in the
    rule is skipped, and a rule must beat its best parent.  At most ``depth``
    rounds; each reads the patterns as sets per condition (``plans.vertical``) and gets the beam with it, which is all that the driver sees.
    Equal means and supports are ordered by name.
    """
    p = patterns(df, target, conditions)
    need = F.ceil(_totals(p)["n"] * F.lit(min_support))
    slices = vertical(p, target, "conditions", rows_per_slice or ROWS_PER_SLICE, sums=("_n", "_k", "_s"))
    near = written(redundant_pairs(p, redundancy), "redundant")
    one = _level1(p, min_support).select(F.array("condition").alias("rule"), F.col("mean_r").alias("score"), "support")

    def best(of: DataFrame) -> DataFrame:
        return written(of.orderBy(F.desc(F.round("score", 10)), F.desc("support"), F.array_join("rule", "|")).limit(beam), "beam")

    current = found = best(one)
    for _ in range(depth - 1):
        rules = current.select("rule", "score").collect()  # ``beam`` rules at most
        grown = extended(slices, [r["rule"] for r in rules])
        parents = df.sparkSession.createDataFrame([(i, r["rule"], r["score"]) for i, r in enumerate(rules)], "rule int, _rule array<string>, _parent double")
        close = parents.select("rule", F.explode("_rule").alias("a")).join(near, "a").select("rule", F.col("b").alias("condition"))
        x = grown.join(close, ["rule", "condition"], "left_anti").join(parents, "rule")
        x = x.select(F.array_sort(F.array_append("_rule", F.col("condition"))).alias("rule"), F.col("n").alias("support"), div("s", F.col("k").cast("double")).alias("score"), "_parent")
        # a rule that several parents lead to has the same rows from each
        g = x.groupBy("rule").agg(F.max("support").alias("support"), F.max_by("score", "_parent").alias("score"), F.max("_parent").alias("_best"))
        g = g.filter((F.col("support") >= need) & (F.col("score") > F.col("_best") + 1e-10))
        current = best(g.select("rule", "score", "support"))
        if current.isEmpty():
            break
        found = found.unionByName(current)
    return found.withColumn("depth", F.size("rule"))


def match_rules(df: DataFrame, rules: DataFrame, conditions: str = "conditions") -> DataFrame:
    """One row per (row, rule it meets); rules are (rule_id, rule), any number of them.

    A rule is looked up by its two rarest conditions together (a rule of one condition by that), so a row meets hardly any rule
    that it does not satisfy; further conditions are then checked inside the row.  A rule without conditions meets no row.
    """
    rarity = condition_registry(df, 0.0, conditions)
    each = rules.select("rule_id", "rule", F.explode("rule").alias("condition")).join(rarity, "condition", "left")
    rarest = F.array_sort(F.collect_set(F.struct(F.coalesce("support", F.lit(0)).alias("n"), "condition")))
    keyed = written(each.groupBy("rule_id").agg(F.first("rule").alias("_rule"), F.transform(F.slice(rarest, 1, 2), lambda z: z["condition"]).alias("_c")), "keyed")
    first, second = F.get("_c", F.lit(0)), F.get("_c", F.lit(1))
    ones = keyed.where(F.size("_c") == 1).select("rule_id", first.alias("_a"))
    twos = keyed.where(F.size("_c") == 2).select("rule_id", "_rule", F.least(first, second).alias("_a"), F.greatest(first, second).alias("_b"))
    rows = df.withColumn("_sorted", F.array_sort(F.array_distinct(conditions)))
    by_one = rows.withColumn("_a", F.explode(conditions)).join(ones, "_a").drop("_a", "_sorted")
    by_two = rows.withColumn("_p", F.explode(pairs_of("_sorted", _width(df, conditions)))).withColumns({"_a": F.col("_p.a"), "_b": F.col("_p.b")}).join(twos, ["_a", "_b"])
    more = (F.size("_rule") <= 2) | F.forall("_rule", lambda z: F.array_contains(F.col(conditions), z))
    return by_two.filter(more).drop("_p", "_a", "_b", "_rule", "_sorted").unionByName(by_one)


def score_rules(df: DataFrame, rules: DataFrame, target: str, fee: float = 0.05, multipliers=(2, 5, 10), conditions: str = "conditions") -> DataFrame:
    """Mean, median, positive rate, lift, profit factor, Sharpe, spread over symbols and regimes, cost stress.

    Rows are counted by their conditions and result, symbol or regime first; only these counts meet the rules, and every figure, the
    median too, is rolled up from them.
    """
    of = F.col(conditions).alias("conditions")
    cells = written(df.groupBy(of, F.col(target).alias("_x")).agg(F.count(F.lit(1)).alias("_c")), "cells")
    hits = written(match_rules(cells.select("conditions").distinct(), rules), "hits")
    m = written(cells.join(hits, "conditions").groupBy("rule_id", "_x").agg(F.sum("_c").alias("_c")), "rule-counts")
    x, w = F.col("_x"), F.col("_c")
    base = cells.select(div(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)).cast("double"))).scalar()
    known = F.when(x.isNotNull(), w)
    mean = div(F.sum(x * w), F.sum(known).cast("double"))
    means = m.groupBy("rule_id").agg(
        F.sum(w).alias("n"), mean.alias("mean_r"), (F.sum(F.when(x > 0, w).otherwise(0)) / F.sum(w)).alias("positive_rate"),
        div(F.sum(F.when(x > 0, x * w).otherwise(0.0)), F.abs(F.sum(F.when(x < 0, x * w).otherwise(0.0)))).alias("profit_factor"))
    spread = m.join(means.select("rule_id", "mean_r"), "rule_id").groupBy("rule_id").agg(
        F.sqrt(div(F.sum(w * (x - F.col("mean_r")) * (x - F.col("mean_r"))), F.sum(known).cast("double"))).alias("std_r"))
    g = means.join(spread, "rule_id")
    sd = F.col("std_r")
    g = g.withColumn("sharpe", F.when(sd > 0, F.col("mean_r") / F.when(sd > 0, sd) * F.sqrt(F.col("n").cast("double"))).otherwise(0.0))
    med = exact_quantiles(m, ["rule_id"], "_x", {"median_r": 0.5}, times="_c").drop("n")
    g = g.join(med, "rule_id")
    for key in ("symbol", "regime"):
        part = df.groupBy(of, key).agg(F.sum(target).alias("_s"), F.count(target).alias("_k"))
        per = part.join(hits, "conditions").groupBy("rule_id", key).agg(div(F.sum("_s"), F.sum("_k").cast("double")).alias("_m"))
        cv = per.groupBy("rule_id").agg(div(F.stddev_pop("_m"), F.abs(F.avg("_m"))).alias(f"{key}_cv"))
        g = g.join(cv, "rule_id")
    g = g.withColumn("lift", F.coalesce(div(F.col("mean_r"), base), F.lit(0.0)))
    return g.withColumns({f"fee_{k}x": F.col("mean_r") - fee * (k - 1) for k in multipliers})


# ---- multiple testing ----------------------------------------------------------

# fixed values: coefficients of the error-function approximation 7.1.26 of Abramowitz and Stegun
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def norm_cdf(z) -> Column:
    """Normal distribution function by a rational approximation (error below 1.5e-7)."""
    z = c(z)
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + _ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(_ERF):
        poly = (poly + a) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


# fixed values: coefficients of Acklam's approximation to the normal quantile, numerators and denominators of the middle and the tails
_PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
_PPF_TAIL = 0.02425


def norm_ppf(p) -> Column:
    """Normal quantile by a rational approximation (relative error below 1.2e-9)."""
    p = F.lit(p) if isinstance(p, float) else c(p)

    def poly(coef, x):
        out = F.lit(coef[0])
        for a in coef[1:]:
            out = out * x + a
        return out

    low, q = F.least(p, 1.0 - p), p - 0.5
    t = F.sqrt(-2.0 * F.log(F.when(low > 0, low)))
    tail = poly(_PPF_C, t) / poly(_PPF_D, t)
    return F.when(low >= _PPF_TAIL, poly(_PPF_A, q * q) * q / poly(_PPF_B, q * q)).when(q < 0, tail).otherwise(-tail)


def p_values(rules: DataFrame) -> DataFrame:
    """Two-sided p of a mean different from zero."""
    z = div(F.col("mean_r") * F.sqrt(F.col("n").cast("double")), F.col("std_r"))
    return rules.withColumn("p_value", F.coalesce(2.0 * (1.0 - norm_cdf(F.abs(z))), F.lit(1.0)))


def correct(rules: DataFrame, alpha: float = 0.05, q: float = 0.05) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg decisions (one row per rule)."""
    w = Window.partitionBy()
    m = F.count(F.lit(1)).over(w)
    r = rules.withColumns({"m": m, "rank": F.row_number().over(w.orderBy("p_value", "rule_id"))})
    cut = F.max(F.when(F.col("p_value") <= F.col("rank") / F.col("m") * q, F.col("rank"))).over(w)
    return r.withColumns({"bonferroni": F.col("p_value") <= alpha / F.col("m"),
                          "bh": F.coalesce(F.col("rank") <= cut, F.lit(False)),
                          "adjusted_p": F.least(F.lit(1.0), F.col("p_value") * F.col("m") / F.col("rank"))})


def deflated_sharpe(sharpe, n, trials) -> Column:
    """Sharpe less what the best of ``trials`` rules without merit would show; ``trials`` is a column or a number."""
    n = c(n).cast("double")
    trials = c(trials) if isinstance(trials, (str, Column)) else F.lit(trials)
    return c(sharpe) * F.sqrt((n - 1) / n) - norm_ppf(1.0 - 0.5 / trials) / F.sqrt(n)


# ---- deduplication and validation ------------------------------------------------

def rule_similarity(df: DataFrame, rules: DataFrame, target: str, conditions: str = "conditions") -> DataFrame:
    """0.6*Jaccard + 0.4*|return correlation| of rule pairs that share rows.

    Sums per rule and per pair are enough for both parts; the pairs are those of
    the rules one pattern of conditions meets, and they are added up map-side.  A missing target counts as 0.
    """
    x = match_rules(patterns(df, target, conditions), rules).groupBy("conditions").agg(
        *[F.coalesce(F.first(f"_{v}"), F.lit(0.0 if v in "sq" else 0)).alias(f"_{v}") for v in "nsq"], F.array_sort(F.collect_list("rule_id")).alias("hit"))
    x = written(x.select("_n", "_s", "_q", "hit"), "hits")
    one = x.select("_n", "_s", "_q", F.explode("hit").alias("rule_id")).groupBy("rule_id").agg(*[F.sum(f"_{v}").alias(v) for v in "nsq"])
    two = x.select("_n", "_q", F.explode(pairs_of("hit", _width(x, "hit"))).alias("p")).groupBy("p.a", "p.b").agg(
        F.sum("_n").alias("nab"), F.sum("_q").alias("qab"))
    j = two.join(one.select(F.col("rule_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("q").alias("qa")), "a") \
        .join(one.select(F.col("rule_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("q").alias("qb")), "b")
    u = (F.col("na") + F.col("nb") - F.col("nab")).cast("double")
    ma, mb = F.col("sa") / u, F.col("sb") / u
    va, vb = F.col("qa") / u - ma * ma, F.col("qb") / u - mb * mb
    corr = F.when((u >= 5) & (va > 1e-24) & (vb > 1e-24), div(F.col("qab") / u - ma * mb, F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0))))).otherwise(0.0)
    return j.select("a", "b", (F.col("nab") / u).alias("jaccard"), corr.alias("corr"),
                    (0.6 * F.col("nab") / u + 0.4 * F.abs(F.coalesce(corr, F.lit(0.0)))).alias("similarity"))


def dedupe_rules(rules: DataFrame, similarity: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Connected components of similar rules; the best mean represents its family.

    Smallest label wins along the edges until nothing changes; each round is cut
    off from its lineage (one row per rule).
    """
    e = similarity.filter(F.col("similarity") >= threshold).select("a", "b")
    edges = cut_lineage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    lab = cut_lineage(rules.select("rule_id", F.col("rule_id").alias("family")))
    while True:
        near = edges.join(lab, F.col("b") == F.col("rule_id")).groupBy("a").agg(F.min("family").alias("_f"))
        new = lab.join(near, F.col("rule_id") == F.col("a"), "left").select(
            "rule_id", F.least(F.col("family"), F.coalesce("_f", F.col("family"))).alias("family"), F.col("family").alias("_old"))
        new = cut_lineage(new)
        done = new.filter(F.col("family") != F.col("_old")).isEmpty()
        lab = new.drop("_old")
        if done:
            break
    j = rules.select("rule_id", "mean_r").join(lab, "rule_id")
    w = Window.partitionBy("family").orderBy(F.desc(F.round("mean_r", 10)), "rule_id")
    return j.withColumn("is_representative", F.row_number().over(w) == 1)


def validate_rules_oos(df: DataFrame, rules: DataFrame, target: str, min_ratio: float = 0.5, min_rows: int = 10,
                       conditions: str = "conditions") -> DataFrame:
    """Mean per split, out-of-sample ratio, sign and decay checks (df has ``split``)."""
    m = match_rules(patterns(df, target, conditions, by=("split",)), rules)

    def part(s):
        n, k, x = (F.sum(F.when(F.col("split") == s, F.col(v))) for v in ("_n", "_k", "_s"))
        return [F.coalesce(n, F.lit(0)).alias(f"n_{s}"), div(x, k.cast("double")).alias(f"mean_{s}")]

    g = m.groupBy("rule_id").agg(*part("discovery"), *part("validation"), *part("holdout"))
    ratio = F.coalesce(div(F.col("mean_validation"), F.col("mean_discovery")), F.lit(0.0))
    g = g.withColumns({"oos_is_ratio": ratio, "sign_ok": F.coalesce(F.signum("mean_discovery") == F.signum("mean_validation"), F.lit(False)),
                       "overfit": ratio < min_ratio})
    enough = (F.col("n_discovery") >= min_rows) & (F.col("n_validation") >= min_rows)
    return g.withColumn("status", F.when(~enough, "REJECTED").when(F.col("overfit"), "REJECTED")
                        .when(F.col("n_holdout") >= min_rows, "VALIDATED").otherwise("CANDIDATE_ONLY"))


__all__ = [k for k in list(globals()) if not k.startswith("_")]
