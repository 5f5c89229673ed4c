"""Trade analytics (A*): one aggregate pass wherever possible.

Groups such as a mode or a direction may hold a third of all trades.  Plain
aggregates combine map-side; ordered figures (drawdown) and quantiles go through
``portfolio.max_drawdown`` and ``plans.quantiles``, which cut large groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.functions import trading as P
from barlens.functions.core import c, clip, div
from barlens.operators.portfolio import max_drawdown
from barlens.plans.quantiles import exact_quantiles
from barlens.session import written

ORDER = ["closed_at", "order_id"]


def share(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def profit_factor(r) -> Column:
    """Gross profit over gross loss; the gross profit itself without losses."""
    r = c(r)
    win, loss = F.sum(F.when(r > 0, r).otherwise(0.0)), F.abs(F.sum(F.when(r < 0, r).otherwise(0.0)))
    return F.when(loss > 0, div(win, loss)).otherwise(win)


def stats(r: str = "realized_r") -> list[Column]:
    x = F.col(r)
    win, loss = F.when(x > 0, x), F.when(x <= 0, x)
    gp, gl = F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.coalesce(F.sum(loss), F.lit(0.0)))
    return [F.count(F.lit(1)).alias("trades"), F.count(win).alias("wins"), F.count(loss).alias("losses"),
            (share(x > 0) * 100.0).alias("win_rate"), F.avg(x).alias("avg_r"),
            F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.abs(F.avg(loss)), F.lit(0.0)).alias("avg_loss"),
            F.when(gl > 0, div(gp, gl)).otherwise(gp).alias("profit_factor"), gp.alias("gross_profit_r"),
            gl.alias("gross_loss_r"), (gp - gl).alias("net_r"), F.avg(x).alias("expectancy")]


def trade_stats(df: DataFrame, r: str = "realized_r") -> DataFrame:
    return df.agg(*stats(r))


def trade_stats_by(df: DataFrame, dims: list[str], r: str = "realized_r") -> DataFrame:
    """Overall and per value of each dimension in one pass (grouping sets)."""
    g = df.groupingSets([[]] + [[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        *stats(r), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dim, label = F.lit("ALL"), F.lit("ALL")
    for d in dims:
        dim = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dim)
        label = F.when(F.col(f"_g_{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit("UNKNOWN"))).otherwise(label)
    return g.withColumns({"dim": dim, "label": label}).drop(*dims, *[f"_g_{d}" for d in dims])


def _labels(dims: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("UNKNOWN")).alias("label")) for d in dims])


def by_dims(df: DataFrame, dims: list[str], keep: list[str]) -> DataFrame:
    """One row per trade and dimension: (dim, label, kept columns)."""
    return df.select(*keep, F.explode(_labels(dims)).alias("_d")).select("_d.dim", "_d.label", *keep)


def group_metrics(df: DataFrame, dims: list[str], min_samples: int = 10) -> DataFrame:
    """Win rate, R figures, drawdown, hold, exit shares, score and reliability per (dim, label)."""
    keep = ["realized_r", "hold_minutes", "close_reason"]
    df = written(df.select(*dict.fromkeys([*dims, *keep, *ORDER])), "trades")
    x = by_dims(df, dims, keep)
    r = F.col("realized_r")
    g = x.groupBy("dim", "label").agg(
        F.count(F.lit(1)).alias("trades"), share(r > 0).alias("win_rate"), F.avg(r).alias("avg_realized_r"),
        F.sum(r).alias("net_r"), profit_factor(r).alias("profit_factor"), F.avg("hold_minutes").alias("avg_hold_minutes"),
        share(F.col("close_reason") == "HIT_SL").alias("stop_hit_pct"), share(F.col("close_reason") == "HIT_TP").alias("target_hit_pct"),
        share(F.col("close_reason") == "TIME_STOP").alias("time_exit_pct"))
    dd = max_drawdown(df, ["dim", "label"], ORDER, "realized_r", "max_drawdown_r", groups=_labels(dims))
    g = g.join(dd, ["dim", "label"])
    n = F.col("trades")
    return g.withColumns({"expectancy_score": F.col("avg_realized_r") * F.sqrt(n.cast("double")),
                          "reliability": P.reliability(n, F.lit(min_samples)), "provisional": n < min_samples})


def leaderboard_by(metrics: DataFrame) -> DataFrame:
    """Rank labels per dimension by score; provisional ones follow by size (one row per label)."""
    w = Window.partitionBy("dim").orderBy(
        "provisional", F.when(F.col("provisional"), None).otherwise(F.col("expectancy_score")).desc_nulls_last(),
        F.when(F.col("provisional"), F.col("trades")).desc_nulls_last(), "label")
    return metrics.withColumn("rank", F.row_number().over(w))


def boards(metrics: DataFrame, k: int) -> DataFrame:
    """Best and worst k stable labels of each dimension."""
    m = metrics.filter(~F.col("provisional"))
    up = Window.partitionBy("dim").orderBy(F.desc("expectancy_score"), "label")
    dn = Window.partitionBy("dim").orderBy("expectancy_score", F.desc("label"))
    m = m.withColumns({"best_rank": F.row_number().over(up), "worst_rank": F.row_number().over(dn)})
    return m.filter((F.col("best_rank") <= k) | (F.col("worst_rank") <= k))


def session_hour_heatmap(df: DataFrame, session: str, hour: str) -> DataFrame:
    return df.groupBy(session).pivot(hour, list(range(24))).count().select(
        session, *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h:02d}") for h in range(24)])


def confidence_buckets(df: DataFrame) -> DataFrame:
    lo = F.greatest(F.lit(0), F.least(F.lit(90), F.floor(F.col("confidence") / 10) * 10)).cast("int")
    return df.withColumn("bucket", lo).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("trades"), share(F.col("realized_r") > 0).alias("win_rate"),
        F.avg("realized_r").alias("avg_realized_r"), F.avg("confidence").alias("avg_confidence"))


def confidence_monotonicity(buckets: DataFrame) -> DataFrame:
    """Share of neighbouring buckets (at most ten rows) whose mean result does not fall."""
    w = Window.partitionBy().orderBy("bucket")
    b = buckets.withColumn("_p", F.lag("avg_realized_r").over(w)).filter(F.col("_p").isNotNull())
    g = b.agg(F.count(F.lit(1)).alias("pairs"), share(F.col("avg_realized_r") >= F.col("_p")).alias("score"))
    s = F.col("score")
    return g.withColumn("status", F.when(s.isNull(), "INSUFFICIENT_DATA").when(s >= 0.75, "PASS").when(s >= 0.5, "MIXED").otherwise("FAILED"))


def time_stop_analysis(df: DataFrame, dims: list[str]) -> DataFrame:
    """Duration error of time exits, overall and by dimension (grouping sets)."""
    e = F.col("error_ratio")
    ts = df.filter("close_reason = 'TIME_STOP'")
    g = ts.groupingSets([[]] + [[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.count(F.lit(1)).alias("time_stops"), F.avg("hold_minutes").alias("avg_hold_minutes"), F.avg("realized_r").alias("avg_realized_r"),
        F.avg(e).alias("duration_error"), F.avg(F.abs(e)).alias("duration_error_abs"), share(F.abs(e) <= 0.25).alias("within_25pct"),
        share(e > 0.25).alias("overrun_rate"), share(e < -0.25).alias("underrun_rate"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    return _dim_label(g, dims)


def _dim_label(g: DataFrame, dims: list[str]) -> DataFrame:
    dim, label = F.lit("ALL"), F.lit("ALL")
    for d in dims:
        on = F.col(f"_g_{d}") == 0
        dim, label = F.when(on, F.lit(d)).otherwise(dim), F.when(on, F.col(d).cast("string")).otherwise(label)
    return g.withColumns({"dim": dim, "label": label}).drop(*dims, *[f"_g_{d}" for d in dims])


def rate_dashboards(df: DataFrame, dims: list[str]) -> DataFrame:
    """Stop, time and stale exit rates and the result when they happen."""
    cr, r = F.col("close_reason"), F.col("realized_r")
    aggs = [F.count(F.lit(1)).alias("trades")]
    for name, v in (("stop", "HIT_SL"), ("time", "TIME_STOP"), ("stale", "EARLY_STALE_EXIT")):
        aggs += [share(cr == v).alias(f"{name}_rate"), F.coalesce(F.avg(F.when(cr == v, r)), F.lit(0.0)).alias(f"{name}_avg_r")]
    g = df.groupingSets([[]] + [[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        *aggs, *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    return _dim_label(g, dims)


def period_comparison(df: DataFrame, key: str, as_of: Column, days: int, min_samples: int = 10) -> DataFrame:
    """Current against prior window per key with a verdict, in one conditional aggregate."""
    t = F.col("closed_at")
    cut, start = as_of - F.expr(f"interval {days} days"), as_of - F.expr(f"interval {2 * days} days")
    cur, old = t >= cut, (t >= start) & (t < cut)
    r = F.col("realized_r")
    g = df.filter(t >= start).groupBy(key).agg(
        F.count(F.when(cur, 1)).alias("trades_now"), F.count(F.when(old, 1)).alias("trades_prior"),
        F.avg(F.when(cur, r)).alias("avg_r_now"), F.avg(F.when(old, r)).alias("avg_r_prior"))
    g = g.filter(F.col("trades_now") >= min_samples).withColumn("known", F.col("trades_prior") >= min_samples)
    d = F.when(F.col("known"), F.col("avg_r_now") - F.col("avg_r_prior"))
    return g.withColumn("delta_avg_r", d).withColumn("verdict", F.when(~F.col("known"), "emerging").when(d > 0.2, "improving")
                        .when((d < -0.2) & (F.col("avg_r_prior") > 0) & (F.col("avg_r_now") < 0), "worsening")
                        .when(d < -0.2, "decaying").otherwise("steady")).drop("known")


# ---- failures ---------------------------------------------------------------

def failure_breakdown(df: DataFrame, key: str) -> DataFrame:
    g = df.groupBy(F.coalesce(F.col(key), F.lit("UNKNOWN")).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    total = df.select(F.count(F.lit(1))).scalar()
    return g.withColumn("percent", F.col("count") / total * 100.0)


def source_component_matrix(df: DataFrame) -> DataFrame:
    """Counts by source and component with both margins."""
    g = df.cube("failure_source", "blamed_component").agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("level"))
    return g.withColumns({"failure_source": F.coalesce("failure_source", F.lit("ALL")),
                          "blamed_component": F.coalesce("blamed_component", F.lit("ALL"))})


def severity_histogram(df: DataFrame) -> DataFrame:
    s = F.greatest(F.lit(1), F.least(F.lit(5), F.col("severity_score")))
    g = df.withColumn("severity", s).groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    total = df.select(F.count(F.lit(1))).scalar()
    levels = df.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("severity"))
    return levels.join(g, "severity", "left").select(
        "severity", F.coalesce("count", F.lit(0)).alias("count"), (F.coalesce("count", F.lit(0)) / total * 100.0).alias("percent"))


def ranked_improvements(df: DataFrame) -> DataFrame:
    """Weight = count * mean severity per (source, component); equal advice is listed once."""
    g = df.groupBy("failure_source", "blamed_component").agg(
        F.count(F.lit(1)).alias("count"), F.avg("severity_score").alias("avg_severity"), F.avg("confidence").alias("avg_confidence"),
        F.max_by("classification", F.struct(F.col("confidence"), F.col("order_id"))).alias("improvement"))
    g = g.withColumn("weight_score", F.col("count") * F.col("avg_severity"))
    w = Window.partitionBy(F.lower("improvement")).orderBy(F.desc("weight_score"), "failure_source", "blamed_component")
    return g.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def _known(df: DataFrame) -> DataFrame:
    """Failures with gaps filled as the reports count them: unknown labels, no confidence, no severity."""
    return df.withColumns({"failure_source": F.coalesce("failure_source", F.lit("UNKNOWN")), "blamed_component": F.coalesce("blamed_component", F.lit("UNKNOWN")),
                           "confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), "severity_score": F.coalesce("severity_score", F.lit(0))})


def weakness_profile(df: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Ranked sources with their heaviest component and the advice of the surest case."""
    x = _known(df).filter(F.col("confidence") >= min_confidence)
    comp = x.groupBy("failure_source", "blamed_component").agg(F.sum("severity_score").alias("_w"))
    top = comp.groupBy("failure_source").agg(F.max_by("blamed_component", F.struct("_w", "blamed_component")).alias("top_component"))
    g = x.groupBy("failure_source").agg(
        F.count(F.lit(1)).alias("count"), F.avg("severity_score").alias("avg_severity"),
        F.max_by("classification", F.struct("confidence", "order_id")).alias("best_improvement"))
    return g.withColumn("weight_score", F.col("count") * F.col("avg_severity")).join(top, "failure_source")


def weakness_components(df: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Components, over all sources (failure_source 'ALL') and within each: count, mean severity and confidence, weight, the source
    they are most often seen with, the advice of the surest case, and the place by weight.

    Equal counts of sources go to the last name, equal weights to the first.  One shuffle of counts by (source, component); the totals are rolled up from them.
    """
    x = _known(df).filter(F.col("confidence") >= min_confidence)
    surest = F.max(F.struct("confidence", "order_id", "classification"))
    per = x.groupBy("failure_source", "blamed_component").agg(F.count(F.lit(1)).alias("_n"), F.sum("severity_score").alias("_s"), F.sum("confidence").alias("_c"), surest.alias("_best"))

    def board(of: DataFrame, source: Column) -> DataFrame:
        g = of.groupBy(source.alias("failure_source"), "blamed_component").agg(
            F.sum("_n").alias("count"), (F.sum("_s") / F.sum("_n")).alias("avg_severity"), (F.sum("_c") / F.sum("_n")).alias("avg_confidence"),
            F.max_by("failure_source", F.struct("_n", "failure_source")).alias("top_source"), F.max("_best").alias("_best"))
        return g.withColumns({"weight_score": F.col("count") * F.col("avg_severity"), "best_improvement": F.col("_best.classification")}).drop("_best")

    out = board(per, F.lit("ALL")).unionByName(board(per, F.col("failure_source")))
    w = Window.partitionBy("failure_source").orderBy(F.desc("weight_score"), "blamed_component")
    return out.withColumn("place", F.row_number().over(w))


# ---- components -----------------------------------------------------------------

def component_impact(df: DataFrame, components: str = "components", min_samples: int = 10) -> DataFrame:
    """Result with each component against the mean over all component rows."""
    df = written(df.select("realized_r", "confidence", "close_reason", *ORDER, components), "trades")
    x = df.select("realized_r", "confidence", "close_reason", F.explode(components).alias("component"))
    base = x.agg(F.avg("realized_r").alias("b"), F.avg("confidence").alias("q"))
    r = F.col("realized_r")
    g = x.groupBy("component").agg(
        F.count(F.lit(1)).alias("trades"), share(r > 0).alias("win_rate"), F.avg(r).alias("avg_realized_r"), F.sum(r).alias("net_r"),
        profit_factor(r).alias("profit_factor"), F.avg("confidence").alias("_c"), share(F.col("close_reason") == "HIT_SL").alias("stop_hit_pct"))
    g = g.join(max_drawdown(df, ["component"], ORDER, "realized_r", "max_drawdown_r", groups=F.transform(components, lambda z: F.struct(z.alias("component")))), "component")
    b, q = base.select("b").scalar(), base.select("q").scalar()
    return g.withColumns({"expectancy_delta": F.col("avg_realized_r") - b, "confidence_delta": F.col("_c") - q,
                          "sample_reliability": P.component_reliability("trades", min_samples)}).drop("_c")


def combination_impact(df: DataFrame, components: str = "components", first: int = 3, min_samples: int = 10) -> DataFrame:
    """Result by the sorted leading components of a trade (two or more)."""
    x = df.withColumn("_c", F.array_sort(F.array_distinct(F.col(components)))).filter(F.size("_c") >= 2)
    x = x.withColumn("label", F.concat_ws(" + ", F.slice("_c", 1, first)))
    g = x.groupBy("label").agg(F.count(F.lit(1)).alias("trades"), F.avg("realized_r").alias("avg_realized_r"))
    return g.withColumn("sample_reliability", P.component_reliability("trades", min_samples))


def change_impact(df: DataFrame, at: Column, components: str = "components", min_samples: int = 10) -> DataFrame:
    """Mean result per component before and after a change."""
    x = df.select("closed_at", "realized_r", F.explode(components).alias("component"))
    after = F.col("closed_at") >= at
    g = x.groupBy("component").agg(
        F.count(F.when(~after, 1)).alias("trades_before"), F.count(F.when(after, 1)).alias("trades_after"),
        F.coalesce(F.avg(F.when(~after, F.col("realized_r"))), F.lit(0.0)).alias("avg_r_before"),
        F.coalesce(F.avg(F.when(after, F.col("realized_r"))), F.lit(0.0)).alias("avg_r_after"))
    return g.withColumns({"expectancy_delta": F.col("avg_r_after") - F.col("avg_r_before"),
                          "sample_reliability": P.component_reliability("trades_after", min_samples)})


FACTOR_SCHEMA = "array<struct<role:string,score:double,weight:double,used:boolean>>"


def confidence_weights(df: DataFrame, dims: list[str], factors: str = "factors_json", min_trades: int = 5) -> DataFrame:
    """Per group and factor role: mean of max(R,0)*score*weight, scaled to sum one."""
    n = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_trades)
    x = df.select(*dims, "realized_r", F.explode(F.from_json(factors, FACTOR_SCHEMA)).alias("f"))
    x = x.filter(F.coalesce("f.used", F.lit(True)))
    v = F.greatest(F.col("realized_r"), F.lit(0.0)) * F.greatest(F.abs("f.score"), F.lit(0.05)) * F.greatest("f.weight", F.lit(0.1))
    g = x.groupBy(*dims, F.upper("f.role").alias("role")).agg(F.avg(v).alias("_v"))
    g = g.join(n.drop("_n"), dims, "left_semi")
    return g.withColumn("weight", div(F.col("_v"), F.sum("_v").over(Window.partitionBy(*dims)))).drop("_v")


def learning_multiplier(df: DataFrame, requests: DataFrame, min_rows: int = 5) -> DataFrame:
    """Multiplier of the first scope with enough trades: exact, regime, mode, symbol.

    Four small summaries are joined to the requests; the trades are read once
    per summary and never joined themselves.  The win rate is a mean of whole percents, so that a rate
    on a limit is not rounded below it.
    """
    exact = ["symbol", "interval", "mode", "direction", "regime", "band"]
    x = df.withColumn("band", P.confidence_band("confidence"))
    out = requests.withColumn("band", P.confidence_band("confidence"))
    scopes = [("EXACT", exact), ("REGIME", ["regime"]), ("MODE", ["mode"]), ("SYMBOL", ["symbol"])]
    for name, keys in scopes:
        g = x.groupBy(*keys).agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("realized_r") > 0, 100.0).otherwise(0.0)).alias("wr"),
                                          profit_factor("realized_r").alias("pf"), F.lit(name).alias("scope")).alias(f"_{name}"))
        out = out.join(g.filter(F.col(f"_{name}.n") >= min_rows), keys, "left")
    best = F.coalesce(*[F.col(f"_{n}") for n, _ in scopes])
    out = out.withColumn("_b", best)
    wr, pf = F.col("_b.wr"), F.col("_b.pf")
    m = (F.when(wr.isNull(), 1.0).when((wr >= 65) & (pf >= 1.4), 1.2).when((wr >= 58) & (pf >= 1.1), 1.1)
         .when((wr <= 40) | (pf < 0.8), 0.75).when((wr <= 48) | (pf < 1.0), 0.9).otherwise(1.0))
    return out.select(*requests.columns, m.alias("multiplier"), F.coalesce("_b.n", F.lit(0)).alias("sample_size"),
                      F.coalesce("_b.scope", F.lit("none")).alias("scope"))


# ---- summaries --------------------------------------------------------------------

def timing_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = exact_quantiles(df, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
    g = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("avg"), F.min(value).alias("min"),
                              F.max(value).alias("max"), F.sum(value).alias("total"))
    return g.join(q, keys)


def daily_performance(df: DataFrame) -> DataFrame:
    """Per day: trades, net R, running equity and drawdown (one row per day)."""
    from barlens.operators.portfolio import equity_curve
    g = df.groupBy(F.date_trunc("day", "closed_at").alias("day")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("realized_r").alias("net_r"), share(F.col("realized_r") > 0).alias("win_rate"))
    return equity_curve(g, [], ["day"], "net_r", slice_col=F.date_trunc("year", F.col("day")))


def profitability(df: DataFrame, keys: list[str], r: str = "realized_r", per_year: float = 252) -> DataFrame:
    df = written(df.select(*dict.fromkeys([*keys, r, "fee_r", "close_reason", "symbol", *ORDER])), "trades")
    x = F.col(r)
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(x).alias("total_net_r"), F.avg(x).alias("avg_net_r"), F.stddev_samp(x).alias("_sd"),
        profit_factor(x).alias("profit_factor"), share(x > 0).alias("win_rate"), F.sum("fee_r").alias("total_fee_r"),
        F.sum(x + F.col("fee_r")).alias("total_gross_r"), share(F.col("close_reason") == "HIT_SL").alias("stop_pct"),
        share(F.col("close_reason") == "HIT_TP").alias("target_pct"))
    med = exact_quantiles(df, keys, r, {"median_net_r": 0.5}).drop("n")
    dd = max_drawdown(df, keys, ORDER, r, "max_drawdown_r")
    sym = df.groupBy(*keys, "symbol").agg(F.sum(x).alias("_s"))
    dom = sym.groupBy(*keys).agg(div(F.max(F.abs("_s")), F.sum(F.abs("_s"))).alias("dominant_share"))
    for t in (med, dd, dom):
        g = g.join(t, keys)
    return g.withColumns({
        "sharpe": F.when(F.col("_sd") > 1e-12, F.col("avg_net_r") / F.col("_sd") * math.sqrt(per_year)).otherwise(0.0),
        "calmar": F.when(F.col("max_drawdown_r") > 1e-12, F.col("avg_net_r") / F.col("max_drawdown_r")).otherwise(0.0)}).drop("_sd")


def fold_metrics(df: DataFrame, keys: list[str], r: str, per_year: float = 252) -> DataFrame:
    """Expectancy, Sharpe, profit factor, win rate and costs per fold."""
    x = F.col(r)
    sd = F.stddev_samp(x)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("expectancy"),
        F.when(sd > 1e-12, F.avg(x) / F.when(sd > 1e-12, sd) * math.sqrt(per_year)).otherwise(0.0).alias("sharpe"),
        profit_factor(x).alias("profit_factor"), share(x > 0).alias("win_rate"))


def cost_decomposition(gross, fee: float, slip: float, fund: float) -> dict[str, Column]:
    a = F.abs(c(gross))
    return {"fee": a * fee, "slippage": a * slip, "funding": a * fund, "total_cost": a * (fee + slip + fund),
            "net_r": c(gross) - a * (fee + slip + fund)}


def economic_metrics(df: DataFrame, action: str, gross: str, fee: float, slip: float, keys: list[str]) -> DataFrame:
    """Counts, gross and net totals and exposure of a decision table."""
    act = F.col(action) != "NO_TRADE"
    n = F.count(F.when(act, 1))
    g = F.sum(F.when(act, F.col(gross)).otherwise(0.0))
    net = g - n * (fee + slip)
    return df.groupBy(*keys).agg(
        n.alias("active_trades"), F.count(F.when(F.col(action) == "LONG_NOW", 1)).alias("long_trades"),
        F.count(F.when(F.col(action) == "SHORT_NOW", 1)).alias("short_trades"), F.count(F.when(~act, 1)).alias("no_trades"),
        g.alias("total_gross_r"), (n * fee).alias("total_fee_r"), (n * slip).alias("total_slippage_r"), net.alias("total_net_r"),
        div(net, n).alias("avg_net_r_active"), (net / F.count(F.lit(1))).alias("avg_net_r_decision"),
        (n / F.count(F.lit(1)) * 100.0).alias("exposure_pct"))


def concentration(df: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """Shares of a total by key: leader, Herfindahl index, share of the top three."""
    g = df.groupBy(key).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("double").alias("_w"))
    w = Window.partitionBy()
    g = g.withColumns({"_s": div(F.col("_w"), F.sum("_w").over(w)),
                       "_k": F.row_number().over(w.orderBy(F.desc("_w"), key))})
    return g.agg(F.count(F.lit(1)).alias("n_keys"), F.max_by(key, -F.col("_k")).alias("top_key"), F.max("_s").alias("top_share"),
                 F.sum(F.col("_s") * F.col("_s")).alias("hhi"), F.sum(F.when(F.col("_k") <= 3, F.col("_s"))).alias("top3_share"))


def regime_breakdown(df: DataFrame, rare: float = 0.05, catastrophic: float = -0.5) -> DataFrame:
    total = df.select(F.count(F.lit(1))).scalar()
    g = df.groupBy("regime").agg(F.count(F.lit(1)).alias("trades"), F.avg("realized_r").alias("expectancy"),
                                 share(F.col("realized_r") > 0).alias("win_rate"))
    return g.withColumns({"sample_pct": F.col("trades") / total, "is_rare": F.col("trades") / total < rare,
                          "is_catastrophic": F.col("expectancy") < catastrophic})


def symbol_regime_matrix(df: DataFrame, regimes: list[str]) -> DataFrame:
    return df.groupBy("symbol").pivot("regime", regimes).agg(F.avg("realized_r"))


def no_trade_trend(df: DataFrame, order: list[str], no_trade: str, window: int, threshold: float = 0.8) -> DataFrame:
    """NO_TRADE share per consecutive window of rows; first against second half.

    Rows are numbered with prefix counts, then everything is a group aggregate.
    """
    from barlens.plans.ordered import running
    p = running(df.select(*dict.fromkeys([*order, no_trade])), [], order, {"_i": ("count", F.lit(1))})
    g = p.withColumn("window", F.floor((F.col("_i") - 1) / F.lit(window))).groupBy("window").agg(
        share(F.col(no_trade)).alias("pct"), F.count(F.lit(1)).alias("n"))
    n = g.select(F.count(F.lit(1))).scalar()
    half = F.col("window") < F.floor(n / F.lit(2))
    s = g.agg(F.avg(F.when(half, F.col("pct"))).alias("first_half"), F.avg(F.when(~half, F.col("pct"))).alias("second_half"),
              F.max("pct").alias("max_pct"), F.min("pct").alias("min_pct"), F.max(F.col("pct") >= threshold).alias("collapse"),
              F.count(F.lit(1)).alias("windows"))
    ch = (F.col("second_half") - F.col("first_half")) * 100
    return s.withColumn("trend", F.when(ch > 5, "increasing").when(ch < -5, "decreasing").otherwise("stable"))


def counterfactual_no_trade(df: DataFrame, keys: list[str], no_trade: Column, net: str) -> DataFrame:
    x = df.filter(no_trade)
    r = F.col(net)
    g = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("no_trades"), F.count(F.when(r < -1e-10, 1)).alias("saved_count"),
        F.count(F.when(r > 1e-10, 1)).alias("missed_count"), F.sum(F.when(r < -1e-10, -r).otherwise(0.0)).alias("saved_r"),
        F.sum(F.when(r > 1e-10, r).otherwise(0.0)).alias("missed_r"))
    return g.withColumns({"counterfactual_r": F.col("saved_r") - F.col("missed_r"),
                          "saved_missed_ratio": F.when(F.col("missed_r") > 1e-10, div("saved_r", "missed_r"))})


def label_distribution(df: DataFrame, label: str, by: str) -> DataFrame:
    g = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def no_trade_patterns(df: DataFrame, keys: list[str], decision: str, outcome: str, expected: str) -> DataFrame:
    nt = F.col(decision) == "NO_TRADE"
    o = F.col(outcome)
    saved = F.sum(F.when(nt & (o < 0), -o).otherwise(0.0))
    missed = F.sum(F.when(nt & (o > 0), o).otherwise(0.0))
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("decisions"), share(nt).alias("no_trade_rate"), F.count(F.when(nt, 1)).alias("no_trades"),
        F.count(F.when(nt & (o < 0), 1)).alias("correct_no_trades"), saved.alias("saved_r"), missed.alias("missed_r"),
        F.count(F.when(nt & (F.col(expected) > 0.5), 1)).alias("over_suppression"),
        F.count(F.when(~nt & (o < -1.0), 1)).alias("under_suppression"))
    rate, cr = F.col("no_trade_rate"), F.col("correct_no_trades") / F.greatest(F.col("no_trades"), F.lit(1))
    pats = F.filter(F.array(
        F.when(rate > 0.7, F.lit("excessive_no_trade")).when(rate > 0.5, "elevated_no_trade"),
        F.when(cr < 0.4, F.lit("low_correct_rate")),
        F.when((F.col("missed_r") > F.col("saved_r") * 1.5) & (F.col("saved_r") > 0), F.lit("net_harmful_avoidance")),
        F.when(F.col("over_suppression") > F.col("no_trades") * 0.3, F.lit("over_suppression"))), lambda x: x.isNotNull())
    return g.withColumns({"correct_rate": cr, "patterns": F.array_join(pats, ",")})


def baseline_delta(current: DataFrame, baseline: DataFrame, key: str, cols: list[str], threshold: float = 0.1) -> DataFrame:
    b = baseline.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_{x}") for x in cols])
    j = current.join(b, F.col(key) == F.col("_k"))
    j = j.select(key, *[(F.col(x) - F.col(f"_{x}")).alias(f"{x}_delta") for x in cols])
    return j.withColumn("significant", F.abs(F.col(f"{cols[0]}_delta")) > threshold)


def cost_stress(df: DataFrame, r: str, fee: str, multipliers: list[float], keys: list[str]) -> DataFrame:
    """Mean result when the fee is charged m times, and whether it survives."""
    x = df.select(*keys, r, fee, F.explode(F.array(*[F.lit(float(m)) for m in multipliers])).alias("multiplier"))
    g = x.groupBy(*keys, "multiplier").agg(F.avg(F.col(r) - F.col(fee) * (F.col("multiplier") - 1)).alias("mean_net_r"))
    base = df.groupBy(*keys).agg(F.avg(r).alias("_b"), F.avg(fee).alias("_f"))
    g = g.join(base, keys) if keys else g.withColumn("_o", F.lit(1)).join(base.withColumn("_o", F.lit(1)), "_o").drop("_o")
    return g.withColumns({"mean_change": F.col("mean_net_r") - F.col("_b"), "edge_survives": F.col("mean_net_r") > 0,
                          "break_even_multiple": F.when(F.col("_b") > 0, 1.0 + div("_b", "_f"))}).drop("_b", "_f")


def histogram(df: DataFrame, value: str, size: float, threshold: float) -> DataFrame:
    b = F.floor(F.col(value) / size) * size
    d = F.col("direction")
    return df.withColumn("bucket_start", b.cast("double")).groupBy("bucket_start").agg(
        F.count(F.lit(1)).alias("count"), F.count(F.when(d == "LONG", 1)).alias("buy_count"), F.count(F.when(d == "SHORT", 1)).alias("sell_count"),
        F.count(F.when(F.col(value) < threshold, 1)).alias("below_threshold"))


def what_if(df: DataFrame, value: str, current: float, thresholds: list[float]) -> DataFrame:
    """Rows that another threshold would newly include."""
    x = df.select(value, "symbol", "realized_r", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    new = (F.col(value) >= F.col("threshold")) & (F.col(value) < current)
    return x.groupBy("threshold").agg(
        F.count(F.when(F.col(value) >= F.col("threshold"), 1)).alias("included"), F.count(F.when(new, 1)).alias("newly_included"),
        F.count_distinct(F.when(new, F.col("symbol"))).alias("new_symbols"), F.avg(F.when(new, F.col("realized_r"))).alias("new_avg_r"))


def circuit_state(df: DataFrame, failures: DataFrame, window: int = 20, streak_window: int = 50, max_rate: float = 70.0, max_losses: int = 6,
                  max_severity: float = 4.0) -> DataFrame:
    """State from the newest trades and failures: failure rate, loss streak, mean severity of the last five failures, rules that hold.

    Only the newest rows are kept, by distributed top-n.  A rule that is reached opens the circuit; without one, a rule that is near degrades it.
    """
    last = df.orderBy(F.desc("closed_at"), F.desc("order_id")).limit(streak_window)
    w = Window.partitionBy().orderBy(F.desc("closed_at"), F.desc("order_id"))
    x = last.withColumn("_i", F.row_number().over(w))
    first_win = F.min(F.when(F.col("realized_r") > 0, F.col("_i")))
    g = x.agg(F.coalesce(F.avg(F.when(F.col("_i") <= window, F.when(F.col("realized_r") <= 0, 100.0).otherwise(0.0))), F.lit(0.0)).alias("failure_rate"),
              (F.coalesce(first_win, F.count(F.lit(1)) + 1) - 1).alias("consecutive_losses"),
              F.count(F.when(F.col("_i") <= window, 1)).alias("analyzed"))
    five = failures.orderBy(F.desc("created_at"), F.desc("order_id")).limit(5)
    g = g.withColumns({"avg_severity": five.agg(F.coalesce(F.avg(F.coalesce("severity_score", F.lit(0))), F.lit(0.0))).scalar(),
                       "_f": five.agg(F.count(F.lit(1))).scalar()})
    fr, cl, sv = F.col("failure_rate"), F.col("consecutive_losses"), F.col("avg_severity")
    reached = {"max_consecutive_losses": cl >= max_losses, "max_failure_rate_pct": (fr >= max_rate) & (F.col("analyzed") >= min(window, 3)),
               "max_severity_avg": (sv >= max_severity) & (F.col("_f") >= 3)}
    near = {"near_failure_rate": fr >= max(max_rate * 0.8, max_rate - 10.0), "near_consecutive_losses": cl >= max(max_losses - 1, 1),
            "near_severity": sv >= max(max_severity - 0.5, max_severity * 0.85)}

    def names(rules: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))

    g = g.withColumn("_open", names(reached)).withColumn("_near", names(near))
    return g.withColumns({"active_rules": F.concat_ws(",", F.when(F.size("_open") > 0, F.col("_open")).otherwise(F.col("_near"))),
                          "status": F.when(F.size("_open") > 0, "OPEN").when(F.size("_near") > 0, "DEGRADED").otherwise("CLOSED")}).drop("_open", "_near", "_f")


def circuit_boards(df: DataFrame, session: str, window: int = 20) -> DataFrame:
    """Losses among the newest trades by session and by hour of their close, in percent of these losses."""
    last = df.orderBy(F.desc("closed_at"), F.desc("order_id")).limit(window).filter(F.col("realized_r") <= 0)
    hour = F.coalesce(F.format_string("%02d:00", F.hour("closed_at")), F.lit("unknown"))
    one = last.select(F.explode(F.array(F.struct(F.lit("session").alias("board"), F.coalesce(F.col(session), F.lit("unknown")).alias("label")),
                                        F.struct(F.lit("hour").alias("board"), hour.alias("label")))).alias("x")).select("x.*")
    g = one.groupBy("board", "label").agg(F.count(F.lit(1)).alias("losses"))
    return g.withColumn("percent", F.round(F.col("losses") * 100.0 / F.sum("losses").over(Window.partitionBy("board")), 2))


def symbol_throttle(df: DataFrame, lookback: int = 12, max_streak: int = 3, max_rate: float = 70.0, cooldown_min: int = 240) -> DataFrame:
    """Per symbol: stop rate and stop streak of the newest trades and the end of the cooldown."""
    w = Window.partitionBy("symbol").orderBy(F.desc("closed_at"), F.desc("order_id"))
    x = df.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= lookback)
    stop = F.col("close_reason") == "HIT_SL"
    g = x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trade_count"), F.count(F.when(stop, 1)).alias("stop_hits"), (share(stop) * 100.0).alias("stop_rate_pct"),
        (F.coalesce(F.min(F.when(~stop, F.col("_i"))), F.count(F.lit(1)) + 1) - 1).alias("consecutive_stop_hits"),
        F.max(F.when(stop, F.col("closed_at"))).alias("_last"), F.avg("fee_r").alias("avg_fee_r"))
    hit = (F.col("consecutive_stop_hits") >= max_streak) | (F.col("stop_rate_pct") >= max_rate)
    return g.withColumns({"throttled": hit, "cooldown_until": F.when(hit, F.col("_last") + F.expr(f"interval {cooldown_min} minutes"))}).drop("_last")


def baseline_excess(df: DataFrame, dims: list[str], r: str, min_group: int = 10) -> DataFrame:
    """Group mean (global mean for small groups), excess over it and its bucket.

    Group means are a small table joined back, not a window over the groups.
    """
    df = written(df, "trades")
    g = df.groupBy(*dims).agg(F.avg(r).alias("_m"), F.count(r).alias("_n"))
    total = df.select(F.avg(r)).scalar()
    g = g.withColumn("baseline_mean", F.when(F.col("_n") >= min_group, F.col("_m")).otherwise(total)).drop("_m", "_n")
    j = df.join(g, dims).withColumn("excess_r", F.col(r) - F.col("baseline_mean"))
    return j.withColumn("excess_bucket", P.excess_bucket("excess_r"))


def quartile_bucket(df: DataFrame, value: str, out: str) -> DataFrame:
    """low / mid_low / mid_high / high by the exact quartiles of the whole table."""
    q = exact_quantiles(df, [], value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    got = q.first()  # three numbers
    q1, q2, q3 = (F.lit(got[k]) if got else F.lit(None).cast("double") for k in ("q1", "q2", "q3"))
    x = F.col(value)
    return df.withColumn(out, F.when(x <= q1, "low").when(x <= q2, "mid_low").when(x <= q3, "mid_high").when(x > q3, "high").otherwise("mid"))


def baselines(df: DataFrame, label: str, gross: str, fee: float, order: list[str]) -> DataFrame:
    """Always long, always short, no trade and random actions judged on the same labels."""
    h = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *order)), 1, 8), 16, 10).cast("bigint"), F.lit(3))
    rnd = F.when(h == 0, "LONG_NOW").when(h == 1, "SHORT_NOW").otherwise("NO_TRADE")
    acts = F.array(*[F.struct(F.lit(n).alias("baseline"), a.alias("pred")) for n, a in (
        ("ALWAYS_LONG", F.lit("LONG_NOW")), ("ALWAYS_SHORT", F.lit("SHORT_NOW")), ("NO_TRADE", F.lit("NO_TRADE")), ("RANDOM_ACTION", rnd))])
    x = df.select(F.col(label).alias("_y"), F.col(gross).alias("_g"), F.explode(acts).alias("a")).select("_y", "_g", "a.*")
    y, p, g, cost = F.col("_y"), F.col("pred"), F.col("_g"), 2.0 * fee
    net = (F.when(p == "NO_TRADE", None).when(y == "NO_TRADE", -cost).when(p == y, g - cost).otherwise(-g - cost))
    x = x.withColumn("_n", net)
    return x.groupBy("baseline").agg(
        F.coalesce(F.avg("_n"), F.lit(0.0)).alias("net_expectancy"),
        F.coalesce(div(F.avg("_n"), F.stddev_samp("_n")), F.lit(0.0)).alias("net_sharpe"), F.count("_n").alias("active_trades"),
        (F.count("_n") / F.count(F.lit(1)) * 100.0).alias("exposure_pct"))


def shadow_agreement(live: DataFrame, shadow: DataFrame, key: str, action: str, r: str) -> DataFrame:
    s = shadow.select(key, F.col(action).alias("_a"), F.col(r).alias("_r"))
    j = live.join(s, key)
    return j.agg(F.count(F.lit(1)).alias("compared"), share(F.col(action) == F.col("_a")).alias("match_rate"),
                 F.avg(F.col("_r") - F.col(r)).alias("mean_r_difference"),
                 share((F.col(action) != F.col("_a")) & (F.col("_r") < F.col(r))).alias("degradation_rate"))


def audit_analytics(df: DataFrame, checks: str) -> DataFrame:
    """Pass share of each named check for winners and losers."""
    x = df.select((F.col("realized_r") > 0).alias("winner"), F.explode(checks).alias("k")).select("winner", "k.name", "k.passed", "k.score")
    return x.groupBy("name", "winner").agg(share(F.col("passed")).alias("pass_rate"), F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n"))


def recommendations(metrics: DataFrame, buckets: DataFrame, min_samples: int, k: int = 3) -> DataFrame:
    """Labels to scale up, to pause, and confidence buckets to tighten."""
    b = boards(metrics, k)
    up = b.filter((F.col("best_rank") <= k) & (F.col("avg_realized_r") > 0)).select(F.lit("scale_up").alias("action"), "dim", "label", F.col("avg_realized_r").alias("value"))
    dn = b.filter((F.col("worst_rank") <= k) & (F.col("avg_realized_r") <= 0)).select(F.lit("reduce_or_pause").alias("action"), "dim", "label", F.col("avg_realized_r").alias("value"))
    tight = buckets.filter((F.col("trades") >= min_samples) & (F.col("avg_realized_r") < 0)).select(
        F.lit("tighten_confidence").alias("action"), F.lit("confidence").alias("dim"), F.col("bucket").cast("string").alias("label"), F.col("avg_realized_r").alias("value"))
    return up.unionByName(dn).unionByName(tight)


# ---- learning -----------------------------------------------------------------------

def learning_calibration(df: DataFrame, min_total: int = 20) -> DataFrame:
    """Multiplier per confidence bucket: realised over predicted win rate, shrunk to the global one."""
    lo = F.least(F.lit(90), F.floor(F.col("confidence") / 10) * 10).cast("int")
    n = df.select(F.count(F.lit(1))).scalar()
    gm = clip(div(df.select(share(F.col("realized_r") > 0)).scalar(), df.select(F.avg("confidence")).scalar() / 100.0), 0.55, 1.05)
    glob = F.when(n >= min_total, gm).otherwise(1.0)
    g = df.groupBy(lo.alias("bucket")).agg(F.count(F.lit(1)).alias("sample_size"), (F.avg("confidence") / 100.0).alias("avg_predicted"),
                                           share(F.col("realized_r") > 0).alias("win_rate"))
    w = clip(F.col("sample_size") / 6.0, 0.4, 1.0)
    own = clip(div("win_rate", "avg_predicted"), 0.55, 1.05)
    return g.withColumn("multiplier", F.when((F.col("sample_size") >= 3) & (F.col("avg_predicted") > 0),
                                             clip(own * w + glob * (1.0 - w), 0.55, 1.05)).otherwise(glob))


def component_penalties(failures: DataFrame) -> DataFrame:
    total = failures.select(F.count(F.lit(1))).scalar()
    src = failures.groupBy("blamed_component", "failure_source").agg(F.count(F.lit(1)).alias("_n"))
    top = src.groupBy("blamed_component").agg(F.max_by("failure_source", F.struct("_n", "failure_source")).alias("top_source"))
    g = failures.groupBy("blamed_component").agg(F.count(F.lit(1)).alias("count"), F.avg("severity_score").alias("avg_severity"),
                                                 F.avg("confidence").alias("avg_confidence")).join(top, "blamed_component")
    f = F.col("count") / total
    p = f * (F.col("avg_severity") / 5.0) * F.greatest(F.col("avg_confidence"), F.lit(0.5))
    p = F.when((f >= 0.55) & (F.col("count") >= 4) & (F.col("avg_confidence") >= 0.7), F.greatest(p, F.lit(0.16))).otherwise(p)
    p = F.when((F.col("blamed_component") == "Stop Loss") & (F.col("top_source") == "RISK_MODEL") & (f >= 0.5), F.greatest(p, F.lit(0.2))).otherwise(p)
    return g.withColumns({"frequency": f, "penalty": clip(p, 0.0, 0.35)})


# fixed values: rows that learning needs, and what the rejection rules ask for
MIN_CLOSED, MIN_FAILURES = 20, 5
REJECT_ENTRY_RISK, REJECT_ENTRY_RISK_UNKNOWN, REJECT_CONFIDENCE = 0.72, 0.75, 68.0


def entry_and_stop_rules(failures: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Entry-timing penalty, stop multiplier and rejection rules learned from the losses, one row.

    ``closed`` are the closed trades: learning is active from MIN_CLOSED of them and MIN_FAILURES losses on; without it only the
    losses are asked for.  A severity that is missing or 0 counts as 1, a missing confidence as 0.
    """
    x = failures.withColumns({"_v": F.when(F.coalesce("severity_score", F.lit(0)) == 0, 1).otherwise(F.col("severity_score")),
                              "_c": F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))})
    s, b, k = (F.coalesce(q, F.lit("")) for q in ("failure_source", "blamed_component", "classification"))
    timing = (s == "TIMING") | (b == "Entry Logic")
    stop = (s == "RISK_MODEL") | (b == "Stop Loss") | (k == "STOP_LOSS_HIT")

    def part(cond, name):
        return [F.coalesce(share(cond), F.lit(0.0)).alias(f"{name}_rate"), F.avg(F.when(cond, F.col("_v"))).alias(f"_{name}_v"),
                F.avg(F.when(cond, F.col("_c"))).alias(f"_{name}_c"), F.count(F.when(cond, 1)).alias(f"_{name}_n")]

    g = x.agg(*part(timing, "timing"), *part(stop, "stop"), F.count(F.lit(1)).alias("_n"))
    n_closed = F.lit(MIN_CLOSED) if closed is None else closed.select(F.count(F.lit(1))).scalar()
    tr, tv, tc, tn = (F.col(q) for q in ("timing_rate", "_timing_v", "_timing_c", "_timing_n"))
    sr, sv, sc, sn = (F.col(q) for q in ("stop_rate", "_stop_v", "_stop_c", "_stop_n"))
    active = (n_closed >= MIN_CLOSED) & (F.col("_n") >= MIN_FAILURES)
    pen = clip(tr * (tv / 5.0) * F.greatest(tc, F.lit(0.5)), 0.0, 1.0) * 0.35
    pen = F.when((tr >= 0.55) & (tn >= 4) & (tc >= 0.7), F.greatest(pen, F.lit(0.15))).otherwise(pen)
    pen = F.when((tr >= 0.7) & (tv >= 4.0), F.greatest(pen, F.lit(0.22))).otherwise(pen)
    mult = 1.0 + clip(sr * (sv / 5.0) * F.greatest(sc, F.lit(0.5)) * 0.8, 0.0, 0.55)
    top = x.groupBy(F.coalesce("failure_source", F.lit("UNKNOWN")), F.coalesce("blamed_component", F.lit("UNKNOWN"))).agg(F.count(F.lit(1)).alias("_k")) \
        .agg(F.coalesce(F.max("_k") / F.sum("_k"), F.lit(0.0)))
    g = g.withColumn("dominant_cluster", top.scalar())
    return g.select(
        "timing_rate", "stop_rate", F.when(tn > 0, clip(pen, 0.0, 0.35)).otherwise(0.0).alias("entry_penalty"), (active & (tn >= 2)).alias("entry_active"),
        F.when(sn > 0, clip(mult, 1.0, 1.8)).otherwise(1.0).alias("stop_multiplier"), (active & (sn >= 3)).alias("stop_active"), "dominant_cluster",
        (active & (F.col("dominant_cluster") >= 0.55)).alias("reject_active"),
        F.when(F.col("_n") > 0, REJECT_ENTRY_RISK).otherwise(REJECT_ENTRY_RISK_UNKNOWN).alias("reject_if_entry_risk_gte"),
        F.lit(REJECT_CONFIDENCE).alias("reject_if_confidence_lte"))


def regime_stability(df: DataFrame, min_total: int = 20) -> DataFrame:
    g = df.groupBy("regime").agg(F.count(F.lit(1)).alias("_n"))
    s = g.agg(F.sum("_n").alias("total"), F.max("_n").alias("_m"), F.count(F.lit(1)).alias("unique_regimes"),
              F.max_by("regime", F.struct("_n", "regime")).alias("dominant_regime"))
    sh, u = F.col("_m") / F.col("total"), F.col("unique_regimes")
    label = (F.when(F.col("total") < min_total, "INSUFFICIENT_DATA").when((u >= 3) & (sh < 0.45), "UNSTABLE")
             .when((u >= 2) & (sh < 0.6), "MIXED").otherwise("STABLE"))
    damp = F.when(label == "UNSTABLE", 0.72).when(label == "MIXED", 0.85).otherwise(1.0)
    return s.withColumns({"dominant_share": sh, "label": label, "damping": damp}).drop("_m")


def learning_effectiveness(df: DataFrame, components: str, severity: str) -> DataFrame:
    """Result, win rate and severity with and without each adjustment.

    'Without' is the total minus 'with', so trades are exploded once and never
    compared with every adjustment.
    """
    x = df.select("realized_r", severity, F.explode(components).alias("adjustment"))
    r = F.col("realized_r")

    def sums():
        return [F.count(F.lit(1)).alias("n"), F.sum(r).alias("s"), F.count(F.when(r > 0, 1)).alias("w"), F.sum(severity).alias("v")]

    g = x.groupBy("adjustment").agg(*sums())
    t = df.agg(*sums()).first()  # one row of four numbers
    n, s, w, v = (F.lit(t[k]) for k in ("n", "s", "w", "v"))
    return g.select("adjustment", F.col("n").alias("trades_with"), (n - F.col("n")).alias("trades_without"),
                    (F.col("s") / F.col("n")).alias("avg_r_with"), div(s - F.col("s"), n - F.col("n")).alias("avg_r_without"),
                    (F.col("w") / F.col("n")).alias("win_rate_with"), div(w - F.col("w"), n - F.col("n")).alias("win_rate_without"),
                    (F.col("v") / F.col("n")).alias("severity_with"), div(v - F.col("v"), n - F.col("n")).alias("severity_without"))


def calibration_readiness(df: DataFrame, least: int = 500) -> DataFrame:
    lo = F.floor(F.col("confidence") / 20) * 20
    g = df.groupBy(lo.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("labelled"), share(F.col("realized_r") > 0).alias("win_rate"))
    return g.withColumn("ready", F.col("labelled") >= least)


# ---- diagnostics ------------------------------------------------------------------------

def decision_diagnostics(df: DataFrame, reason: str, dims: list[str]) -> DataFrame:
    """Counts of decisions, filtered and directional-but-filtered per dimension value."""
    f = F.col(reason).isNotNull()
    g = df.groupingSets([[]] + [[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.count(F.lit(1)).alias("decisions"), F.count(F.when(f, 1)).alias("filtered"),
        F.count(F.when(f & (F.col("direction") == "LONG"), 1)).alias("buy_filtered"),
        F.count(F.when(f & (F.col("direction") == "SHORT"), 1)).alias("sell_filtered"), F.avg("confidence").alias("avg_confidence"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    return _dim_label(g, dims)


def top_blockers(df: DataFrame, reason: str, k: int = 10) -> DataFrame:
    total = df.select(F.count(F.lit(1))).scalar()
    g = df.filter(F.col(reason).isNotNull()).groupBy(reason).agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("mode").alias("modes"))
    return g.withColumn("percentage", F.col("count") * 100.0 / total).orderBy(F.desc("count"), reason).limit(k)


def runtime_rates(df: DataFrame, flags: dict[str, Column], limits: dict[str, float], keys: list[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[share(v).alias(f"{k}_rate") for k, v in flags.items()])
    alerts = F.filter(F.array(*[F.when(F.col(f"{k}_rate") > lim, F.lit(k)) for k, lim in limits.items()]), lambda x: x.isNotNull())
    return g.withColumn("alerts", F.array_join(alerts, ","))


def attribution_integrity(trades: DataFrame, attributed: DataFrame, key: str, by: str) -> DataFrame:
    a = attributed.select(key).distinct().withColumn("_a", F.lit(1))
    return trades.join(a, key, "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("trades"), F.count("_a").alias("attributed"), (F.count("_a") / F.count(F.lit(1))).alias("coverage"))


def before_after_checks(metrics: DataFrame, label: str, value: str, limits: dict[str, float]) -> DataFrame:
    """Value per label against a known-bad level: passes when it is better."""
    m = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return metrics.withColumn("limit", F.try_element_at(m, F.col(label))).filter(F.col("limit").isNotNull()) \
        .withColumn("passed", F.col(value) > F.col("limit"))


def market_overview(bars: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """Latest bar and latest signal per key by aggregates (hot keys merge map-side)."""
    b = bars.groupBy(*keys).agg(F.max("ts").alias("bar_ts"), F.max_by("close", "ts").alias("close"))
    s = signals.groupBy(*keys).agg(F.max("ts").alias("signal_ts"), F.max_by("signal", "ts").alias("signal"))
    return b.join(s, keys, "left")


def manifest_diff(manifests: DataFrame, run: str, params: str) -> DataFrame:
    """Parameters that changed between consecutive runs (one small map per run)."""
    x = manifests.select(run, F.explode(params).alias("name", "value"))
    runs = manifests.select(run).distinct().withColumn("_next", F.lead(run).over(Window.partitionBy().orderBy(run)))
    old = x.join(runs, run).filter(F.col("_next").isNotNull()).select(F.col("_next").alias(run), "name", F.col("value").alias("before"))
    new = x.join(runs.select(F.col("_next").alias(run)), run, "left_semi").withColumnRenamed("value", "after")
    return new.join(old, [run, "name"], "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def candidate_vs_baseline(cand: DataFrame, base: DataFrame, key: str, cols: list[str], tolerance: float = 0.0) -> DataFrame:
    b = base.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_{x}") for x in cols])
    j = cand.join(b, F.col(key) == F.col("_k")).drop("_k")
    j = j.withColumns({f"{x}_delta": F.col(x) - F.col(f"_{x}") for x in cols}).drop(*[f"_{x}" for x in cols])
    good = F.lit(True)
    for x in cols:
        good = good & (F.col(f"{x}_delta") >= -tolerance)
    return j.withColumn("verdict", F.when(good, "BETTER_OR_EQUAL").otherwise("WORSE"))


def filter_on_off(df: DataFrame, on: Column, r: str, trials: int) -> DataFrame:
    """Result with and without a filter, and a deflated-Sharpe p value."""
    x = written(df.select(*ORDER, r, F.array_compact(F.array(F.lit("off"), F.when(on, F.lit("on")))).alias("_v")), "trades")
    both = x.select(r, F.explode("_v").alias("variant"))
    v = F.col(r)
    sd = F.stddev_samp(v)
    g = both.groupBy("variant").agg(F.count(F.lit(1)).alias("trades"), F.avg(v).alias("expectancy"), profit_factor(v).alias("profit_factor"),
                                    div(F.avg(v), sd).alias("sharpe"))
    dd = max_drawdown(x, ["variant"], ORDER, r, "max_drawdown_r", groups=F.transform("_v", lambda z: F.struct(z.alias("variant"))))
    from barlens.operators.mining import norm_cdf, norm_ppf
    z0 = norm_ppf(1.0 - 0.5 / trials)
    n = F.col("trades").cast("double")
    z = F.col("sharpe") * F.sqrt(n - 1) - z0
    return g.join(dd, "variant").withColumn("deflated_p", 1.0 - norm_cdf(z))


def threshold_sweep(df: DataFrame, score: str, r: str, thresholds: list[float], keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    x = df.select(*keys, score, r, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")) \
        .filter(F.col(score) >= F.col("threshold"))
    return x.groupBy(*keys, "threshold").agg(
        F.count(F.lit(1)).alias("trades"), F.count(F.when(F.col(r) > 0, 1)).alias("wins"), share(F.col(r) > 0).alias("win_rate"),
        F.avg(r).alias("mean_r"))


def kelly_stats(df: DataFrame, keys: list[str], r: str) -> DataFrame:
    x = F.col(r)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), share(x > 0).alias("winrate"),
                              F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("avg_win"),
                              F.coalesce(F.abs(F.avg(F.when(x <= 0, x))), F.lit(0.0)).alias("avg_loss"), F.avg(x).alias("base_net_r"))
    b, p = div("avg_win", "avg_loss"), F.col("winrate")
    raw = F.when(F.col("avg_win") == 0, 0.0).when(F.col("avg_loss") == 0, 1.0).otherwise(div(p * b - (1.0 - p), b))
    g = g.withColumns({"payoff_ratio": b, "raw_kelly": raw})
    k = F.greatest(F.col("raw_kelly"), F.lit(0.0))
    return g.withColumns({"half_leverage": F.least(k * 0.5 * 5.0, F.lit(5.0)), "quarter_leverage": F.least(k * 0.25 * 5.0, F.lit(3.0))})


__all__ = [k for k in list(globals()) if not k.startswith("_")]
