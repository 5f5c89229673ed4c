"""Queries: model evaluation, calibration and drift (C*), and the evaluation tests E12..E16."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.operators import features as ft, modeleval as C, splits as SP, trades as A
from barlens.plans import draws as DR
from barlens.queries.features_q import win
from barlens.queries.joins_q import bar_labels
from barlens.queries.labels_q import blocked_bars
from barlens.queries.registry import cte, query
from barlens.queries.trades_q import actions
from barlens.sources import tables as S


def P(spark, d):
    return S.predictions(spark, d)


cte("cbins", """
SELECT b AS bin, count(p) AS count, coalesce(avg(p), (b + 0.5) / 10) AS predicted, coalesce(avg(y::DOUBLE), 0) AS actual, coalesce(avg(p), (b + 0.5) / 10) - coalesce(avg(y::DOUBLE), 0) AS deviation
FROM (SELECT unnest(range(0, 10)) AS b) LEFT JOIN preds ON least(floor(p * 10 + 1e-12), 9) = b GROUP BY b""")


@query("C1_confidence_bins", "bin! count! predicted# actual# deviation#", "SELECT * FROM cbins")
def _(spark, d):
    return C.confidence_bins(P(spark, d), "p", "y")


@query("C2_calibration_error", "ece# mce# n! status", """
SELECT *, CASE WHEN ece < 0.05 THEN 'CALIBRATED' WHEN ece < 0.15 THEN 'UNCALIBRATED' ELSE 'UNRELIABLE' END AS status FROM (SELECT sum(abs(deviation) * count) / sum(count) AS ece, max(abs(deviation)) FILTER (WHERE count > 0) AS mce, sum(count) AS n FROM cbins)""")
def _(spark, d):
    return C.calibration_error(C.confidence_bins(P(spark, d), "p", "y"))


@query("C3_brier", "fold! brier#", "SELECT fold, avg(pow(1 - p - (1 - y), 2) + pow(p - y, 2)) AS brier FROM preds GROUP BY 1")
def _(spark, d):
    return C.brier(P(spark, d).withColumn("probs", F.array(1 - F.col("p"), F.col("p"))), "probs", "y", ["fold"])


cte("fece", """
SELECT fold, sum(abs(mp - ma) * n) / sum(n) AS ece FROM (SELECT fold, least(floor(p * 10 + 1e-12), 9) AS b, count(*) AS n, avg(p) AS mp, avg(y::DOUBLE) AS ma FROM preds GROUP BY 1, 2) GROUP BY 1""")


def fold_ece(spark, d):
    return C.calibration_error(C.confidence_bins(P(spark, d), "p", "y", keys=["fold"]), ["fold"])


@query("C4_fold_degradation", "fold! ece# baseline_ece# ratio# degraded?", "SELECT *, ece / baseline_ece AS ratio, ece > baseline_ece * 1.5 AS degraded FROM (SELECT fold, ece, avg(ece) OVER () AS baseline_ece FROM fece)")
def _(spark, d):
    return C.fold_degradation(fold_ece(spark, d), "fold")


@query("C5_platt", "doc_id! p# calibrated#4")
def _(spark, d):
    x = P(spark, d).withColumn("y", F.col("y").cast("double"))
    return C.platt_fit(x, "p", "y")(x)


@query("C5_isotonic", "doc_id! p# calibrated#4")
def _(spark, d):
    x = P(spark, d).withColumn("y", F.col("y").cast("double"))
    return C.isotonic_fit(x, "p", "y")(x)


@query("C6_classification_metrics", "accuracy# f1_macro# samples!", """
SELECT (SELECT avg(CASE WHEN truth = action THEN 1.0 ELSE 0 END) FROM acts) AS accuracy, avg(coalesce(2.0 * tp / nullif(nt + np, 0), 0)) AS f1_macro, sum(nt) AS samples FROM (SELECT c, count(CASE WHEN truth = c AND action = c THEN 1 END) AS tp, count(CASE WHEN truth = c THEN 1 END) AS nt, count(CASE WHEN action = c THEN 1 END) AS np FROM acts, (SELECT unnest(['LONG_NOW', 'SHORT_NOW', 'NO_TRADE']) AS c) GROUP BY c) WHERE nt + np > 0""")
def _(spark, d):
    return C.classification_metrics(actions(spark, d), "truth", "action")


@query("C6_class_accuracy", "label samples! accuracy#", "SELECT truth AS label, count(*) AS samples, avg(CASE WHEN truth = action THEN 1.0 ELSE 0 END) AS accuracy FROM acts GROUP BY 1")
def _(spark, d):
    return C.class_accuracy(actions(spark, d), "truth", "action")


@query("C7_regression_metrics", "fold! rmse# mae# r2# samples!", """
SELECT fold, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(realized_r) * count(*)) AS r2, count(*) AS samples FROM (SELECT *, realized_r - (p * 4 - 2) AS e FROM preds) GROUP BY 1""")
def _(spark, d):
    return C.regression_metrics(P(spark, d).withColumn("pred", F.col("p") * 4 - 2), "realized_r", "pred", ["fold"])


@query("C8_regression_reliability", "bucket! count! mean_predicted# mean_realized# sign_accuracy# error# monotone?", """
SELECT *, abs(mean_predicted - mean_realized) AS error, coalesce(mean_realized >= lag(mean_realized) OVER (ORDER BY bucket) - 0.01, true) AS monotone FROM (
SELECT least(floor((q - lo) / (hi - lo) * 5), 4) AS bucket, count(*) AS count, avg(q) AS mean_predicted, avg(realized_r) AS mean_realized, avg(CASE WHEN sign(q) = sign(realized_r) THEN 1.0 ELSE 0 END) AS sign_accuracy FROM (SELECT *, p * 4 - 2 AS q, min(p * 4 - 2) OVER () AS lo, max(p * 4 - 2) OVER () AS hi FROM preds) GROUP BY 1)""")
def _(spark, d):
    return C.regression_reliability(P(spark, d).withColumn("pred", F.col("p") * 4 - 2), "realized_r", "pred")


@query("C9_trading_metrics", "fold! n! expectancy# win_rate# profit_factor# max_drawdown#4", """
SELECT fold, count(*) AS n, avg(realized_r) AS expectancy, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) AS win_rate, sum(greatest(realized_r, 0)) / abs(sum(least(realized_r, 0))) AS profit_factor, max(dd) AS max_drawdown
FROM (SELECT *, greatest(0, max(e) OVER (PARTITION BY fold ORDER BY doc_id)) - e AS dd FROM (SELECT *, sum(realized_r) OVER (PARTITION BY fold ORDER BY doc_id) AS e FROM preds)) GROUP BY 1""")
def _(spark, d):
    from barlens.operators.portfolio import max_drawdown
    p = P(spark, d)
    return A.fold_metrics(p, ["fold"], "realized_r").join(max_drawdown(p, ["fold"], ["doc_id"], "realized_r"), "fold")


_PSI = "SELECT sum((a - e) * ln(a / e)) AS psi FROM ({})"


@query("C10_psi_unit", "psi#", _PSI.format("""SELECT least(greatest(count(CASE WHEN fold <= 1 THEN 1 END) / (SELECT count(*) FROM preds WHERE fold <= 1), 0.001), 1) AS e, least(greatest(count(CASE WHEN fold > 1 THEN 1 END) / (SELECT count(*) FROM preds WHERE fold > 1), 0.001), 1) AS a
FROM (SELECT unnest(range(0, 10)) AS b) LEFT JOIN preds ON least(floor(p * 10 + 1e-12), 9) = b GROUP BY b"""))
def _(spark, d):
    p = P(spark, d)
    return C.psi(p.filter("fold <= 1"), p.filter("fold > 1"), "p")


@query("C10_psi_range", "psi#", _PSI.format("""SELECT count(CASE WHEN side = 'buy' THEN 1 END) / (SELECT count(*) FROM ticks WHERE side = 'buy') + 1e-6 AS e, count(CASE WHEN side = 'sell' THEN 1 END) / (SELECT count(*) FROM ticks WHERE side = 'sell') + 1e-6 AS a
FROM (SELECT unnest(range(0, 10)) AS b) LEFT JOIN (SELECT side, least(floor((price - lo) / (hi - lo) * 10 + 1e-12), 9) AS k FROM ticks, (SELECT min(price) AS lo, max(price) AS hi FROM ticks)) ON k = b GROUP BY b"""))
def _(spark, d):
    t = S.ticks(spark, d)
    return C.psi(t.filter("side = 'buy'"), t.filter("side = 'sell'"), "price", variant="range")


@query("C11_ks_two_sample", "ks# p_value#5", """
SELECT ks, least(1, greatest(0, list_sum(list_transform(range(1, 21), lambda k: 2.0 * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * lam * lam))))) AS p_value FROM (SELECT ks, (en + 0.12 + 0.11 / en) * ks AS lam FROM (
SELECT max(abs(ca / na - cb / nb)) AS ks, sqrt(max(na) * max(nb) / (max(na) + max(nb))) AS en FROM (SELECT sum(a) OVER (ORDER BY price)::DOUBLE AS ca, sum(b) OVER (ORDER BY price)::DOUBLE AS cb, sum(a) OVER ()::DOUBLE AS na, sum(b) OVER ()::DOUBLE AS nb FROM (SELECT price, count(CASE WHEN side = 'buy' THEN 1 END) AS a, count(CASE WHEN side = 'sell' THEN 1 END) AS b FROM ticks GROUP BY 1))))""")
def _(spark, d):
    t = S.ticks(spark, d)
    return C.ks_two_sample(t.filter("side = 'buy'"), t.filter("side = 'sell'"), "price")


@query("C12_mean_drift", "feature train_mean# prod_mean# relative_change# drifted?", " UNION ALL ".join(
    f"SELECT '{x}' AS feature, t AS train_mean, q AS prod_mean, CASE WHEN abs(t) > 0.001 THEN abs((q - t) / t) ELSE abs(q - t) END AS relative_change, CASE WHEN abs(t) > 0.001 THEN abs((q - t) / t) ELSE abs(q - t) END > 0.5 AS drifted FROM (SELECT avg({x}) FILTER (WHERE fold <= 1) AS t, avg({x}) FILTER (WHERE fold > 1) AS q FROM preds)" for x in ("p", "realized_r", "y")))
def _(spark, d):
    p = P(spark, d)
    return C.mean_drift(p.filter("fold <= 1"), p.filter("fold > 1"), ["p", "realized_r", "y"])


@query("C13_calibration_decay", "fold! ece# baseline_ece# ratio# state recalibrate?", """
SELECT *, CASE WHEN ratio >= 1.5 THEN 'DECAYED' WHEN ratio >= 1.25 THEN 'WATCH' ELSE 'STABLE' END AS state, ratio >= 1.5 AS recalibrate FROM (SELECT a.fold, a.ece, b.ece AS baseline_ece, a.ece / b.ece AS ratio FROM fece a JOIN fece b ON a.fold = b.fold + 1)""")
def _(spark, d):
    e = fold_ece(spark, d)
    return C.calibration_decay(e.select("fold", "ece"), e.select((F.col("fold") + 1).alias("fold"), "ece"), "fold")


@query("C13_label_quality", "symbol n! valid_rate# ambiguous_rate#", "SELECT symbol, count(*) AS n, avg(CASE WHEN label_validity = 'VALID' THEN 1.0 ELSE 0 END) AS valid_rate, avg(CASE WHEN label_validity = 'AMBIGUOUS' THEN 1.0 ELSE 0 END) AS ambiguous_rate FROM lab4 GROUP BY 1")
def _(spark, d):
    return C.label_quality(bar_labels(spark, d), "symbol", "label_validity")


@query("C14_importance", "feature mean_gain# std_gain# folds! rank! in_top_k? is_noise?", """
SELECT *, rank <= 10 AS in_top_k, mean_gain < av * 0.1 AS is_noise FROM (SELECT *, row_number() OVER (ORDER BY mean_gain DESC, feature) AS rank, avg(mean_gain) OVER () AS av FROM (SELECT symbol AS feature, avg(g) AS mean_gain, stddev_pop(g) AS std_gain, count(DISTINCT mode) AS folds FROM (SELECT symbol, mode, abs(avg(realized_r)) AS g FROM trades GROUP BY 1, 2) GROUP BY 1))""")
def _(spark, d):
    g = S.trades(spark, d).groupBy("symbol", "mode").agg(F.abs(F.avg("realized_r")).alias("g"))
    return C.importance_aggregate(g.withColumnRenamed("symbol", "feature"), "feature", "g", "mode")


_FT = ["body", "rng", "volume"]


def _frame(spark, d):
    from barlens.operators.evaluation import forward_returns
    b = forward_returns(S.bars(spark, d), [1]).filter("fwd_1 is not null")
    return b.withColumns({"body": F.col("close") - F.col("open"), "rng": F.col("high") - F.col("low"), "y": F.when(F.col("fwd_1") > 0, 1.0).otherwise(0.0)})


@query("C15_train_folds", "fold! rows! accuracy#")
def _(spark, d):
    x = _frame(spark, d)
    p = C.train_folds(x, SP.purged_expanding_roles(x, 2, 3), _FT, "y", trees=5)
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), A.share(F.col("prediction") == F.col("y")).alias("accuracy"))


@query("C16_ensemble_agreement", "doc_id! label! agreement# accepted?", """
SELECT doc_id, label, n / 3.0::DOUBLE AS agreement, n / 3.0::DOUBLE >= 0.6 AS accepted FROM (SELECT doc_id, vote AS label, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, vote) AS k FROM (
SELECT doc_id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS vote FROM preds UNION ALL SELECT doc_id, CASE WHEN p >= 0.3 THEN 1 ELSE 0 END FROM preds UNION ALL SELECT doc_id, CASE WHEN realized_r > 0 THEN 1 ELSE 0 END FROM preds) GROUP BY 1, 2) WHERE k = 1""")
def _(spark, d):
    p = P(spark, d)
    v = [F.when(F.col("p") >= 0.5, 1).otherwise(0), F.when(F.col("p") >= 0.3, 1).otherwise(0), F.when(F.col("realized_r") > 0, 1).otherwise(0)]
    return C.ensemble_agreement(p.select("doc_id", F.explode(F.array(*v)).alias("vote")), "doc_id", "vote", 0.6)


@query("C17_group_ablation", "dropped accuracy# delta#")
def _(spark, d):
    x = _frame(spark, d)
    return C.group_ablation(x, SP.purged_expanding_roles(x, 1, 3), {"price": ["body", "rng"], "flow": ["volume"]}, "y", trees=3)


@query("C18_overfit_gap", "fold! train# val# gap# sign_consistency#", """
SELECT *, train - val AS gap, greatest(count(CASE WHEN val > 0 THEN 1 END) OVER (), count(CASE WHEN val < 0 THEN 1 END) OVER ()) / count(*) OVER ()::DOUBLE AS sign_consistency FROM (
SELECT fold, avg(close - open) FILTER (WHERE role = 'train') AS train, avg(close - open) FILTER (WHERE role = 'val') AS val FROM wfa JOIN bars_4h USING (ts) GROUP BY fold)""")
def _(spark, d):
    b = S.bars(spark, d)
    return C.overfit_gap(b.join(SP.walk_forward_roles(b, 60, 50, 10), "ts"), F.col("close") - F.col("open"))


@query("C19_signals_from_predictions", "symbol ts@ side stop_price# target_price# initial_risk#", """
SELECT symbol, ts, CASE cls WHEN 0 THEN 'LONG' ELSE 'SHORT' END AS side, CASE cls WHEN 0 THEN close - atr * 1.5 ELSE close + atr * 1.5 END AS stop_price, CASE cls WHEN 0 THEN close + atr * 2 ELSE close - atr * 2 END AS target_price, atr * 1.5 AS initial_risk
FROM (SELECT *, trade_count % 3 AS cls, (trade_count % 10) / 10.0 AS prob FROM rk) WHERE cls < 2 AND prob >= 0.1 AND atr > 0 AND atr <= close * 0.5""")
def _(spark, d):
    x = ft.on_bars(S.bars(spark, d), 15, ft.atr_group).withColumnRenamed("atr_N", "atr")
    x = x.withColumns({"cls": F.col("trade_count") % 3, "prob": (F.col("trade_count") % 10) / 10.0})
    return C.signals_from_predictions(x, 0.1, 1.5, 2.0)


@query("C20_model_disagreement", "doc_id! disagreement#", "SELECT doc_id, abs(p - q) AS disagreement FROM (SELECT *, (0.2 + 0.15 * fold) AS q FROM preds)")
def _(spark, d):
    q = F.lit(0.2) + F.lit(0.15) * F.col("fold")
    return P(spark, d).withColumn("disagreement", C.model_disagreement(F.array(F.col("p"), 1 - F.col("p")), F.array(q, 1 - q)))


@query("C20_recent_error", "doc_id! recent_error#", "SELECT doc_id, avg(abs(realized_r - p)) OVER (PARTITION BY fold ORDER BY doc_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS recent_error FROM preds")
def _(spark, d):
    return C.recent_error(P(spark, d).withColumn("err", F.col("realized_r") - F.col("p")), ["fold"], ["doc_id"], "err", 20)


@query("C21_threshold_frontier", "fold! threshold#2 trades! wins! win_rate# mean_r#", """
SELECT fold, t AS threshold, count(*) AS trades, count(CASE WHEN realized_r > 0 THEN 1 END) AS wins, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(realized_r) AS mean_r FROM preds, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS t) WHERE p >= t GROUP BY 1, 2""")
def _(spark, d):
    return C.threshold_sweep(P(spark, d), "p", "realized_r", [0.1, 0.3, 0.5, 0.7, 0.9], ["fold"])


@query("C22_symbol_specialists", "symbol ts@ blended#4")
def _(spark, d):
    x = _frame(spark, d)
    sp = C.symbol_specialists(x, _FT, "y")
    return C.blend(x.withColumn("g", F.lit(0.5)), sp, _FT, "g")


# ---- E12..E16 ---------------------------------------------------------------------

@query("E12_factor_signal_events", "symbol ts@ signal_value# entry_price#2 direction", """
SELECT symbol, ts, v AS signal_value, close AS entry_price, 'SHORT' AS direction FROM (SELECT s.* FROM e12 s JOIN e12t t ON s.symbol = t.symbol AND s.ts = t.ts)""",
       e12v=f"SELECT symbol, ts, close, CASE WHEN rn >= 19 THEN (close - avg(close) OVER {win(20)}) / (2 * stddev_samp(close) OVER {win(20)} + 1e-10) END AS v FROM b1",
       e12="SELECT v.* FROM e12v v JOIN (SELECT symbol, quantile_cont(v, 0.1) AS q, count(v) AS n FROM e12v GROUP BY 1) k USING (symbol) WHERE n >= 100 AND v < q",
       e12t="""SELECT symbol, min(ts) AS ts FROM e12 GROUP BY 1 UNION ALL SELECT symbol, nx FROM (SELECT e.symbol, (SELECT min(s.ts) FROM e12 s WHERE s.symbol = e.symbol AND s.ts >= e.ts + INTERVAL '12 hours') AS nx FROM e12t e) WHERE nx IS NOT NULL""")
def _(spark, d):
    from barlens.operators.signals import factor_signal_events
    from barlens.operators.windows import r_mean, r_std
    b = ft.on_bars(S.bars(spark, d, "1 hour"), 20, lambda x: x.withColumn("v", (F.col("close") - r_mean("close", 20, 20)) / (2 * r_std("close", 20, 20) + 1e-10)))
    return factor_signal_events(b, "v", 0.9, "short", 12 * 3600.0)


def mix_sql(*parts):
    """``plans.draws.mixed`` as SQL: a fold over the parts."""
    t = f"(((xor(h, v & 4294967295::UBIGINT)) * {DR.MIX_1}::UBIGINT) & 4294967295::UBIGINT)"
    t = f"((xor({t}, {t} >> 15) * {DR.MIX_2}::UBIGINT) & 4294967295::UBIGINT)"
    return f"list_reduce([0, {', '.join(parts)}]::UBIGINT[], lambda h, v: xor({t}, {t} >> 13))"


_NET = (f"list_reduce([x, {', '.join(map(str, range(DR.ROUNDS)))}]::UBIGINT[], lambda z, r: ((z & m) << b) | xor(z >> b, "
        f"{mix_sql('42', 'i', 'r', 'z & m')} & m))")
_BINOMIAL = ("least(n, len(list_filter(range(0, n + 1), lambda x: list_sum(list_transform(range(0, x + 1), lambda y: "
             "exp(lgamma(n + 1) - lgamma(y + 1) - lgamma(n - y + 1) + y * ln(p) + (n - y) * ln(1 - p)))) < u)))")


@query("E13_shuffle_null_test", "iteration! mean_r# beats_real?", """
SELECT i AS iteration, avg(CASE WHEN x < longs THEN realized_r ELSE -realized_r END) AS mean_r,
 avg(CASE WHEN x < longs THEN realized_r ELSE -realized_r END) >= (SELECT avg(CASE WHEN direction = 'LONG' THEN realized_r ELSE -realized_r END) FROM trades) AS beats_real
FROM e13w WHERE x < n AND step > 0 GROUP BY 1""",
       e13n="SELECT count(*)::UBIGINT AS n, count(CASE WHEN direction = 'LONG' THEN 1 END) AS longs, (CAST(floor(log2(greatest(count(*) - 1, 1))) AS INT) + 2) // 2 AS b FROM trades",
       e13w=f"""SELECT i, realized_r, n, longs, b, ((1::UBIGINT << b) - 1)::UBIGINT AS m, k AS x, 0 AS step FROM (SELECT realized_r, (row_number() OVER (ORDER BY order_id, realized_r) - 1)::UBIGINT AS k FROM trades), e13n, (SELECT unnest(range(0, 5)) AS i)
UNION ALL SELECT i, realized_r, n, longs, b, m, {_NET}, step + 1 FROM e13w WHERE step = 0 OR x >= n""")
def _(spark, d):
    from barlens.operators.signals import shuffle_null_test
    return shuffle_null_test(S.trades(spark, d), "order_id", "direction", "realized_r", 5)


@query("E14_block_bootstrap", "ci_lower# ci_upper# mean_r# n_blocks!", """
SELECT quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper, (SELECT avg(realized_r) FROM trades) AS mean_r, (SELECT count(*) FROM e14b) AS n_blocks
FROM (SELECT i, sum(n * s) / sum(n * c) AS m FROM e14t JOIN e14b ON lo = e14b.b WHERE hi - lo = 1 GROUP BY i)""",
       e14b="SELECT (k // 500)::BIGINT AS b, sum(realized_r) AS s, count(*) AS c FROM (SELECT realized_r, row_number() OVER (ORDER BY closed_at, order_id) - 1 AS k FROM trades) GROUP BY 1",
       e14t=f"""SELECT i, 0::BIGINT AS lo, nb AS hi, nb AS n FROM (SELECT count(*) AS nb FROM e14b), (SELECT unnest(range(0, 1000)) AS i)
UNION ALL SELECT i, CASE side WHEN 0 THEN lo ELSE mid END, CASE side WHEN 0 THEN mid ELSE hi END, CASE side WHEN 0 THEN l ELSE n - l END FROM (
 SELECT *, {_BINOMIAL}::BIGINT AS l FROM (SELECT *, (lo + hi) // 2 AS mid, ((lo + hi) // 2 - lo) / (hi - lo)::DOUBLE AS p, ({mix_sql('42', 'i', 'lo', 'hi')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM e14t WHERE hi - lo > 1)),
 (SELECT unnest([0, 1]) AS side)""")
def _(spark, d):
    from barlens.operators.signals import block_bootstrap_ci
    return block_bootstrap_ci(S.trades(spark, d), ["closed_at", "order_id"], "realized_r", 500, 1000)


@query("E16_rescue_matrix", "symbol source trades! avg_r# classification family", """
SELECT *, CASE WHEN avg_r > 0.02 THEN 'KEEP' WHEN avg_r < -0.3 THEN 'REJECT_FOREVER' WHEN avg_r < -0.1 THEN 'SEGMENT_RESCUE_CANDIDATE' WHEN avg_r < 0 AND avg_r >= -0.05 THEN 'NOISE_NEAR_ZERO' WHEN avg_r < 0 THEN 'FEATURE_ONLY' ELSE 'RETEST_REQUIRED' END AS classification,
  CASE WHEN lower(source) LIKE '%urgent%' OR lower(source) LIKE '%momentum%' THEN 'momentum' WHEN lower(source) LIKE '%high%' THEN 'breakout' WHEN lower(source) LIKE '%low%' THEN 'volatility' WHEN lower(source) LIKE '%medium%' THEN 'trend' ELSE 'other' END AS family
FROM (SELECT symbol, source, count(*) AS trades, avg(realized_r) AS avg_r FROM trades GROUP BY 1, 2)""")
def _(spark, d):
    from barlens.operators.signals import rescue_class, family_by_words
    g = S.trades(spark, d).groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("trades"), F.avg("realized_r").alias("avg_r"))
    words = [("momentum", "urgent|momentum"), ("breakout", "high"), ("volatility", "low"), ("trend", "medium")]
    return g.withColumns({"classification": rescue_class("avg_r"), "family": family_by_words("source", words)})
