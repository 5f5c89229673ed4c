"""Queries: joins (J*) and trading rules per row (P15..P36)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions import trading as P
from barlens.functions.core import div
from barlens.operators import features as ft, joins as J, labels as LB, timegrid as T
from barlens.operators.windows import lag
from barlens.plans.intervals import points_in_ranges
from barlens.plans.ordered import blocked, core_rows
from barlens.queries.features_q import roll
from barlens.queries.registry import cte, query
from barlens.sources import tables as S

# positions: a tick opens one for k hours
cte("posn", "SELECT event_id, symbol, ts AS entry_ts, ts + to_hours(k) AS exit_ts, price FROM ticks")


def positions(spark, d):
    return S.ticks(spark, d).select("event_id", "symbol", F.col("ts").alias("entry_ts"),
                                    F.timestamp_add("HOUR", F.col("k"), F.col("ts")).alias("exit_ts"), "price")


@query("J1_asof_join", "event_id! symbol rate#9 overlay_ts@", """
SELECT t.event_id, t.symbol, CASE WHEN t.ts <= f.ts + INTERVAL '6 hours' THEN f.rate END AS rate,
       CASE WHEN t.ts <= f.ts + INTERVAL '6 hours' THEN f.ts END AS overlay_ts
FROM ticks t ASOF LEFT JOIN funding f ON t.symbol = f.symbol AND t.ts >= f.ts""")
def _(spark, d):
    return J.asof_join(S.ticks(spark, d), S.funding(spark, d), ["symbol"], {"rate": "rate"}, order=["event_id"],
                       tolerance="6 hours")


@query("J2_asof_fill", "symbol ts@ close#2 premium#", """
SELECT b.symbol, b.ts, b.close, CASE WHEN b.ts <= p.ts + INTERVAL '2 hours' THEN p.value ELSE 0 END AS premium
FROM bars_4h b ASOF LEFT JOIN premium p ON b.symbol = p.symbol AND b.ts >= p.ts""")
def _(spark, d):
    return J.asof_fill(S.bars(spark, d), S.premium_index(spark, d), ["symbol"], {"value": "premium"}, "2 hours")


@query("J3_range_join_lookback", "event_id! symbol feature_ts@ value#2", """
SELECT t.event_id, t.symbol, o.ts AS feature_ts, o.value FROM ticks t LEFT JOIN oi o ON o.symbol = t.symbol AND o.ts > t.ts - INTERVAL '6 hours' AND o.ts <= t.ts""")
def _(spark, d):
    t = S.ticks(spark, d).select("event_id", "symbol", "ts")
    return J.range_join_lookback(t, S.open_interest(spark, d), ["symbol"], "6 hours", 6 * 3600)


@query("J4_event_window_sum", "event_id! funding#9 funding_n!", """
SELECT p.event_id, coalesce(sum(f.rate), 0) AS funding, count(f.rate) AS funding_n FROM posn p
LEFT JOIN funding f ON f.symbol = p.symbol AND f.ts > p.entry_ts AND f.ts <= p.exit_ts GROUP BY p.event_id""")
def _(spark, d):
    return J.event_window_sum(positions(spark, d), S.funding(spark, d), ["symbol"], "event_id", "entry_ts", "exit_ts",
                              "rate", "funding")


# labels of bars; a tenth of the keys carries two
cte("lab4", """SELECT symbol, ts, CASE WHEN trade_count % 5 = 0 THEN 'INVALID' WHEN trade_count % 5 = 1 THEN 'AMBIGUOUS' ELSE 'VALID' END AS label_validity,
  ts + to_hours(trade_count % 3) AS label_timestamp, close > open AS up FROM bars_4h WHERE trade_count % 7 <> 3""")


def bar_labels(spark, d):
    n = F.col("trade_count")
    return S.bars(spark, d).filter(n % 7 != 3).select(
        "symbol", "ts", F.when(n % 5 == 0, "INVALID").when(n % 5 == 1, "AMBIGUOUS").otherwise("VALID").alias("label_validity"),
        F.timestamp_add("HOUR", n % 3, F.col("ts")).alias("label_timestamp"), (F.col("close") > F.col("open")).alias("up"))


@query("J5_align_features_labels", "symbol ts@ close#2 up?", """
SELECT b.symbol, b.ts, b.close, l.up FROM bars_4h b JOIN (SELECT * FROM lab4 UNION ALL SELECT * FROM lab4 WHERE hour(ts) = 0) l ON l.symbol = b.symbol AND l.ts = b.ts
WHERE hour(b.ts) <> 0""")
def _(spark, d):
    lb = bar_labels(spark, d)
    dirty = lb.unionByName(lb.filter(F.hour("ts") == 0))
    return J.align_features_labels(S.bars(spark, d), dirty, ["symbol", "ts"])


@query("J6_join_audit", "matched_rows! unmatched_features! unmatched_labels! purge_violations! invalid_labels!", """
SELECT count(CASE WHEN b.ts IS NOT NULL AND l.ts IS NOT NULL THEN 1 END) AS matched_rows, count(CASE WHEN l.ts IS NULL THEN 1 END) AS unmatched_features,
       count(CASE WHEN b.ts IS NULL THEN 1 END) AS unmatched_labels, count(CASE WHEN b.ts >= l.label_timestamp THEN 1 END) AS purge_violations,
       (SELECT count(*) FROM lab4 WHERE label_validity <> 'VALID') AS invalid_labels
FROM (SELECT * FROM bars_4h WHERE volume > 3) b FULL JOIN (SELECT * FROM lab4 WHERE label_validity = 'VALID') l ON l.symbol = b.symbol AND l.ts = b.ts""")
def _(spark, d):
    return J.join_audit(S.bars(spark, d).filter("volume > 3"), bar_labels(spark, d), ["symbol", "ts"], "label_validity", "label_timestamp")


@query("J7_orders_signals_failures", "mode close_reason n! with_signal! with_failure!", """
SELECT t.mode, t.close_reason, count(*) AS n, count(s.symbol) AS with_signal, count(f.order_id) AS with_failure FROM trades t
LEFT JOIN (SELECT DISTINCT symbol, date_trunc('day', opened_at) AS day FROM trades WHERE confidence >= 95) s ON s.symbol = t.symbol AND s.day = date_trunc('day', t.opened_at)
LEFT JOIN (SELECT order_id FROM trades WHERE realized_r < -0.5) f ON f.order_id = t.order_id GROUP BY 1, 2""")
def _(spark, d):
    t = S.trades(spark, d).withColumn("day", F.date_trunc("day", "opened_at"))
    sig = t.filter("confidence >= 95").select("symbol", "day", F.lit(1).alias("sig")).distinct()
    fail = t.filter("realized_r < -0.5").select("order_id", F.lit(1).alias("fail"))
    j = t.join(sig, ["symbol", "day"], "left").join(fail, "order_id", "left")
    return j.groupBy("mode", "close_reason").agg(F.count(F.lit(1)).alias("n"), F.count("sig").alias("with_signal"),
                                                 F.count("fail").alias("with_failure"))


@query("J8_unseen_keys", "order_id seen?", """
SELECT order_id, order_id IN (SELECT order_id FROM trades WHERE mode = 'SCALP') AS seen FROM trades WHERE direction = 'SHORT'""")
def _(spark, d):
    t = S.trades(spark, d)
    ledger, x = t.filter("mode = 'SCALP'"), t.filter("direction = 'SHORT'").select("order_id")
    a = J.seen_keys(x, ledger, ["order_id"]).withColumn("seen", F.lit(True))
    return a.unionByName(J.unseen_keys(x, ledger, ["order_id"]).withColumn("seen", F.lit(False)))


@query("J9_thin_by_min_gap", "symbol ts@", """
SELECT symbol, ts FROM thin_e""", sg="SELECT symbol, ts FROM bars_1h WHERE close > open",
       thin_e="""SELECT symbol, min(ts) AS ts FROM sg GROUP BY symbol
UNION ALL
SELECT symbol, nx FROM (SELECT e.symbol, (SELECT min(s.ts) FROM sg s WHERE s.symbol = e.symbol AND s.ts >= e.ts + INTERVAL '12 hours') AS nx FROM thin_e e) WHERE nx IS NOT NULL""")
def _(spark, d):
    sig = S.bars(spark, d, "1 hour").filter("close > open").select("symbol", "ts")
    return J.thin_by_min_gap(sig, ["symbol"], 12 * 3600.0)


@query("J10_forward_path", "symbol ts@ n! hi#2 lo#2 last#2", """
SELECT symbol, ts, count(high) OVER w AS n, max(high) OVER w AS hi, min(low) OVER w AS lo, last_value(close) OVER w AS last
FROM bars_4h WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)""")
def _(spark, d):
    b = core_rows(J.forward_path(blocked(S.bars(spark, d), 0, 12), 12))
    return b.select("symbol", "ts", F.size("path").alias("n"), F.array_max(F.transform("path", lambda x: x["high"])).alias("hi"),
                    F.array_min(F.transform("path", lambda x: x["low"])).alias("lo"),
                    F.get("path", F.size("path") - 1)["close"].alias("last"))


@query("J11_benchmark_join", "symbol ts@ close#2 bench_close#2", """
SELECT a.symbol, a.ts, a.close, b.close AS bench_close FROM bars_4h a LEFT JOIN (SELECT ts, close FROM bars_4h WHERE symbol = 'S00') b USING (ts)""")
def _(spark, d):
    from barlens.operators.cross import with_benchmark
    return with_benchmark(S.bars(spark, d), S.BENCH, {"close": "bench_close"})


@query("J12_overlap_count", "symbol ts@ open_positions!", """
SELECT symbol, ts, sum(d) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS open_positions FROM (
SELECT symbol, ts, sum(d) AS d FROM (SELECT symbol, entry_ts AS ts, 1 AS d FROM posn UNION ALL SELECT symbol, exit_ts, -1 FROM posn) GROUP BY 1, 2)""")
def _(spark, d):
    return J.overlap_count(positions(spark, d), ["symbol"], "entry_ts", "exit_ts")


@query("J13_mapping_join", "id sym side r#4", "SELECT order_id AS id, symbol AS sym, direction AS side, realized_r AS r FROM trades")
def _(spark, d):
    return J.mapping_join(S.trades(spark, d), {"id": "order_id", "sym": "symbol", "side": "direction", "r": "realized_r"})


@query("J14_attach_outcome", "event_id! symbol notional_k#2", """
SELECT t.event_id, t.symbol, o.o_totalprice / 1000 AS notional_k FROM ticks t LEFT JOIN orders o ON o.o_orderkey = t.event_id * 7""")
def _(spark, d):
    dec = S.ticks(spark, d).withColumn("order_key", F.col("event_id") * 7)
    out = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), (F.col("o_totalprice") / 1000).alias("notional_k"))
    return J.attach_outcome(dec, out, "order_key")


# ---- rules per row ------------------------------------------------------------

# labels of trades under a simple profile
_R = "realized_r"


@query("P17_trend_score", "symbol ts@ trend strength#1", f"""
SELECT symbol, ts, CASE WHEN tot <= 0 THEN 'MIXED' WHEN bull / tot >= 0.67 THEN 'BULLISH' WHEN bull / tot <= 0.33 THEN 'BEARISH' ELSE 'MIXED' END AS trend,
       CASE WHEN tot <= 0 THEN 50 ELSE round_even(bull / tot * 100, 1) END AS strength FROM (
SELECT *, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 0 WHEN (a > b AND b > c) OR (a < b AND b < c) THEN 2 ELSE 1 END + CASE WHEN abs(d) > 0.2 THEN 1 ELSE 0 END + CASE WHEN e IS NOT NULL THEN 0.5 ELSE 0 END::DOUBLE AS tot,
  CASE WHEN a > b AND b > c THEN 2 ELSE 0 END + CASE WHEN d > 0.2 THEN 1 ELSE 0 END + CASE WHEN close > e THEN 0.5 ELSE 0 END::DOUBLE AS bull
FROM (SELECT *, (close - c) / abs(c) * 100 AS d FROM (SELECT symbol, ts, close, {roll('avg({})', 'close', 9)} AS a, {roll('avg({})', 'close', 21)} AS b, {roll('avg({})', 'close', 50)} AS c, {roll('avg({})', 'close', 100)} AS e FROM b4)))""")
def _(spark, d):
    from barlens.operators.windows import r_mean
    b = ft.on_bars(S.bars(spark, d), 100, lambda x: x.withColumns({f"m{n}": r_mean("close", n) for n in (9, 21, 50, 100)}))
    t, s = P.trend_score("close", "m9", "m21", "m50", "m100")
    return b.withColumns({"trend": t, "strength": s})


cte("rk", f"SELECT symbol, ts, close, {roll('avg({})', 'tr', 14)} AS atr, volume, trade_count FROM r4")


def _risk(spark, d):
    return ft.on_bars(S.bars(spark, d), 15, ft.atr_group).withColumnRenamed("atr_N", "atr")


@query("P18_cost_r", "symbol ts@ taker# maker# hybrid# slip# total#", """
SELECT symbol, ts, coalesce(close * 0.0008 / risk, 0) AS taker, coalesce(close * 2 * (0.0002 + 0.0002 * (1 - 0.7::DOUBLE)) / risk, 0) AS maker, coalesce(close * 0.0006 / risk, 0) AS hybrid,
       coalesce(2 * close * 0.0001 * (1 + atr / close) / risk, 0) AS slip, coalesce(close * 0.0008 / risk + 2 * close * 0.0001 * (1 + atr / close) / risk, 0) AS total
FROM (SELECT *, CASE WHEN atr > 0 THEN atr * 1.5 END AS risk FROM rk)""")
def _(spark, d):
    x = _risk(spark, d).withColumn("risk", P.entry_risk("atr", F.lit(1.5)))
    return x.withColumns({"taker": P.fee_r("close", "risk"), "maker": P.fee_r("close", "risk", F.lit("MAKER")),
                          "hybrid": P.fee_r("close", "risk", F.lit("HYBRID")), "slip": P.slippage_r("close", "close", "risk", "atr"),
                          "total": P.total_cost_r("close", "close", "atr", F.lit(1.5))})


@query("P19_simple_costs", "symbol ts@ fee# slip# total#", """
SELECT symbol, ts, coalesce(close * 0.0004 / risk, 0) AS fee, coalesce(close * 0.01 * greatest(1, close / (volume * 10)) / 100 / risk, 0) AS slip,
       coalesce(close * 0.0004 / risk, 0) + coalesce(close * 0.01 * greatest(1, close / (volume * 10)) / 100 / risk, 0) AS total
FROM (SELECT *, CASE WHEN atr > 0 THEN atr * 2.0 END AS risk FROM rk)""")
def _(spark, d):
    x = _risk(spark, d)
    x = x.withColumns({"fee": P.simple_fee_r("close", "atr", F.lit(2.0), F.lit("taker")),
                       "slip": P.simple_slippage_r("close", "atr", F.lit(2.0), F.col("volume") * 10)})
    return x.withColumn("total", F.col("fee") + F.col("slip"))


@query("P20_funding_cost", "order_id scalar# impact#", """
SELECT order_id, CASE WHEN direction = 'SHORT' THEN -1 ELSE 1 END * notional_k * 0.0001::DOUBLE * expected_candles AS scalar,
       CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END * CASE mode WHEN 'SWING' THEN 15 WHEN 'SCALP' THEN 2 ELSE 0 END::DOUBLE * 0.0001::DOUBLE * notional_k / (confidence / 100 * 2) AS impact FROM trades""")
def _(spark, d):
    t = S.trades(spark, d)
    return t.withColumns({"scalar": P.funding_cost("notional_k", F.lit(0.0001), "expected_candles", "direction"),
                          "impact": P.funding_impact_r("notional_k", F.col("confidence") / 100, F.lit(2.0), "mode", "direction")})


@query("P21_funding_status", "event_id! status", """
SELECT event_id, CASE WHEN NOT h AND lg THEN 'LEGACY_SCALAR' WHEN NOT h THEN 'MISSING_DATA' WHEN n > 0 THEN 'APPLIED' ELSE 'AVAILABLE_EMPTY' END AS status FROM (
SELECT p.event_id, substr(p.symbol, 2) <> '07' AS h, p.event_id % 2 = 0 AS lg, count(f.rate) AS n FROM posn p LEFT JOIN funding f ON f.symbol = p.symbol AND f.ts > p.entry_ts AND f.ts <= p.exit_ts GROUP BY ALL)""")
def _(spark, d):
    x = J.event_window_sum(positions(spark, d), S.funding(spark, d), ["symbol"], "event_id", "entry_ts", "exit_ts", "rate", "f")
    return x.withColumn("status", P.funding_status(F.substring("symbol", 2, 2) != "07", "f_n", F.col("event_id") % 2 == 0))


@query("P22_stop_target_levels", "symbol ts@ long_stop# long_target# short_stop# short_target#", """
SELECT symbol, ts, close - atr * 1.5 AS long_stop, close + atr * 2.0 AS long_target, close + atr * 1.5 AS short_stop, close - atr * 2.0 AS short_target FROM rk""")
def _(spark, d):
    return _risk(spark, d).withColumns(P.stop_target_levels("close", "atr", F.lit(1.5), F.lit(2.0)))


cte("q27", "SELECT *, realized_r * 1.3 - 0.2 AS other_r FROM trades")


@query("P23_path_quality", "order_id score#2 bucket", """
SELECT order_id, s AS score, CASE WHEN s >= 0.7 THEN 'HIGH' WHEN s >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS bucket FROM (
SELECT order_id, CASE WHEN m <= 0 THEN 0 WHEN m / greatest(abs(a), 0.001) >= 2 THEN 0.85 WHEN m / greatest(abs(a), 0.001) >= 1 THEN 0.6 WHEN m / greatest(abs(a), 0.001) >= 0.5 THEN 0.4 ELSE 0.2 END AS s
FROM (SELECT order_id, notional_k / 40 AS m, confidence / 100 AS a FROM trades))""")
def _(spark, d):
    t = S.trades(spark, d).withColumn("score", P.path_quality(F.col("notional_k") / 40, F.col("confidence") / 100))
    return t.withColumn("bucket", P.path_quality_bucket("score"))


@query("P24_action_utility", "order_id utility#", """
SELECT order_id, realized_r - 1.0 * abs(confidence / 100) - 1.0 * fee_r - 0.3 * expected_candles * 0.1 AS utility FROM trades""")
def _(spark, d):
    return S.trades(spark, d).withColumn("utility", P.action_utility("realized_r", F.col("confidence") / 100, "fee_r", "expected_candles"))


cte("ntq", """
SELECT *, CASE WHEN s = 0 AND m = 0 THEN 'CORRECT_NO_TRADE' WHEN s > 0 AND m = 0 THEN 'SAVED_LOSS' WHEN m > 0 AND s = 0 THEN 'MISSED_OPPORTUNITY'
  WHEN abs(s - m) < 0.1 THEN 'AMBIGUOUS_NO_TRADE' WHEN s >= m THEN 'SAVED_LOSS' ELSE 'MISSED_OPPORTUNITY' END AS quality
FROM (SELECT *, greatest(0, -least(realized_r, other_r)) AS s, CASE WHEN greatest(realized_r, other_r) > 0.15 THEN greatest(realized_r, other_r) ELSE 0 END AS m
      FROM (SELECT *, -realized_r * 1.3 - 0.2037 AS other_r FROM trades))""")


def _two_sided(spark, d):
    t = S.trades(spark, d).withColumn("other_r", -F.col("realized_r") * 1.3 - 0.2037)
    return t.withColumns(P.no_trade_outcome("realized_r", "other_r", F.lit(1.5), F.lit(1.5), 0.15, 0.1))


@query("P25_no_trade_quality", "order_id saved_loss_r# missed_opportunity_r# saved_loss_score# missed_opportunity_score# no_trade_quality was_correct_skip?", """
SELECT order_id, s AS saved_loss_r, m AS missed_opportunity_r, least(1, s / 1.5) AS saved_loss_score, least(1, m / 1.5) AS missed_opportunity_score,
       quality AS no_trade_quality, quality IN ('CORRECT_NO_TRADE', 'SAVED_LOSS') AS was_correct_skip FROM ntq""")
def _(spark, d):
    return _two_sided(spark, d)


@query("P26_best_action", "order_id best_action second_best_action action_gap_r# is_ambiguous?", """
SELECT order_id, CASE WHEN gap < 0.1 THEN 'NO_TRADE' ELSE r[1].a END AS best_action, r[2].a AS second_best_action, CASE WHEN gap < 0.1 THEN 0 ELSE gap END AS action_gap_r, gap < 0.1 AS is_ambiguous
FROM (SELECT order_id, r, r[2].n - r[1].n AS gap FROM (SELECT order_id, list_sort([{'n': -realized_r, 'i': 0, 'a': 'LONG_NOW'}, {'n': -other_r, 'i': 1, 'a': 'SHORT_NOW'}, {'n': -(s - 0.5 * m), 'i': 2, 'a': 'NO_TRADE'}]) AS r FROM ntq))""")
def _(spark, d):
    x = _two_sided(spark, d)
    return x.withColumns(P.best_action("realized_r", "other_r", "saved_loss_r", "missed_opportunity_r", 0.1))


@query("P27_buckets", "order_id profit excess band decile vol", """
SELECT order_id, CASE WHEN realized_r <= -0.5 THEN 'big_loss' WHEN realized_r <= -0.1 THEN 'loss' WHEN realized_r <= 0 THEN 'breakeven' WHEN realized_r <= 0.1 THEN 'small_win' WHEN realized_r <= 0.5 THEN 'win' ELSE 'big_win' END AS profit,
       CASE WHEN realized_r <= -0.3 THEN 'far_below_baseline' WHEN realized_r <= -0.05 THEN 'below_baseline' WHEN realized_r <= 0.05 THEN 'at_baseline' WHEN realized_r <= 0.3 THEN 'above_baseline' ELSE 'far_above_baseline' END AS excess,
       CASE WHEN confidence < 40 THEN '0-40' WHEN confidence < 60 THEN '40-60' WHEN confidence < 80 THEN '60-80' ELSE '80-100' END AS band,
       concat(least(90, floor(confidence / 10) * 10)::INT, '-', least(90, floor(confidence / 10) * 10)::INT + 10) AS decile,
       CASE WHEN notional_k / 30 >= 1.5 THEN 'HIGH_VOL' WHEN notional_k / 30 >= 1 THEN 'NORMAL_VOL' WHEN notional_k > 0 THEN 'LOW_VOL' ELSE 'UNKNOWN' END AS vol FROM trades""")
def _(spark, d):
    return S.trades(spark, d).withColumns({
        "profit": P.profit_bucket("realized_r"), "excess": P.excess_bucket("realized_r"), "band": P.confidence_band("confidence"),
        "decile": P.confidence_decile("confidence"), "vol": P.volatility_bucket(F.col("notional_k") / 30)})


@query("P28_row_id", "order_id row_id", "SELECT order_id, substr(sha256(concat_ws('_', symbol, order_id, direction)), 1, 16) AS row_id FROM trades")
def _(spark, d):
    return S.trades(spark, d).withColumn("row_id", P.row_id("symbol", "order_id", "direction"))


@query("P29_label_from_outcome", "order_id label_validity best_action_label", """
SELECT order_id, CASE WHEN close_reason = 'EARLY_STALE_EXIT' THEN 'INVALID' WHEN u THEN 'AMBIGUOUS' ELSE 'VALID' END AS label_validity,
       CASE WHEN close_reason = 'EARLY_STALE_EXIT' THEN 'INVALID_OR_UNRESOLVED' WHEN u THEN 'AMBIGUOUS_STATE' WHEN greatest(realized_r, other_r) < e THEN 'NO_TRADE' WHEN realized_r > other_r THEN 'LONG_NOW' ELSE 'SHORT_NOW' END AS best_action_label
FROM (SELECT *, abs(realized_r - other_r) < CASE mode WHEN 'SWING' THEN 0.2 WHEN 'SCALP' THEN 0.1 ELSE 0.05 END AS u, CASE mode WHEN 'SWING' THEN 0.35 WHEN 'SCALP' THEN 0.15 ELSE 0.08 END AS e FROM ntq)""")
def _(spark, d):
    x = _two_sided(spark, d)
    st = F.when(F.col("close_reason") == "EARLY_STALE_EXIT", "UNRESOLVED").otherwise("COMPLETE")
    return x.withColumns(P.label_from_outcome("mode", st, F.lit(False), "realized_r", "other_r"))


@query("P30_policy_decision", "order_id recommended_action n_failed!", """
SELECT order_id, CASE WHEN NOT c THEN 'NO_TRADE' WHEN lp AND (NOT sp OR realized_r >= other_r) THEN 'LONG_NOW' WHEN sp THEN 'SHORT_NOW' ELSE 'NO_TRADE' END AS recommended_action,
       (NOT c)::INT + (NOT la)::INT + (NOT sa)::INT + (NOT lr)::INT + (NOT sr)::INT + (NOT rl)::INT + (NOT rs)::INT AS n_failed FROM (
SELECT *, la AND lr AND rl AS lp, sa AND sr AND rs AS sp FROM (
SELECT *, confidence / 100 >= CASE mode WHEN 'SCALP' THEN 0.6 WHEN 'AGGRESSIVE_SCALP' THEN 0.65 ELSE 0.58 END AS c, realized_r >= a AS la, other_r >= a AS sa, realized_r >= e AS lr, other_r >= e AS sr, g <> 'TREND_DOWN' AS rl, g <> 'TREND_UP' AS rs
FROM (SELECT *, CASE mode WHEN 'SCALP' THEN 0.1 WHEN 'AGGRESSIVE_SCALP' THEN 0.06 ELSE 0.2 END AS a, CASE mode WHEN 'SCALP' THEN 0.15 WHEN 'AGGRESSIVE_SCALP' THEN 0.08 ELSE 0.35 END AS e,
      CASE regime WHEN 'TREND' THEN 'TREND_UP' WHEN 'RANGE' THEN 'RANGE' ELSE 'TREND_DOWN' END AS g FROM ntq)))""")
def _(spark, d):
    x = _two_sided(spark, d)
    g = F.when(F.col("regime") == "TREND", "TREND_UP").when(F.col("regime") == "RANGE", "RANGE").otherwise("TREND_DOWN")
    x = x.withColumns(P.policy_decision("mode", F.col("confidence") / 100, "realized_r", "other_r", "realized_r", "other_r", g))
    return x.withColumn("n_failed", F.size("failed_gates"))


@query("P31_regret", "order_id regret#", """
SELECT order_id, greatest(0, greatest(realized_r - l * confidence / 100, other_r - l * fee_r, s - 0.5 * m) - CASE WHEN direction = 'LONG' THEN realized_r ELSE other_r END) AS regret
FROM (SELECT *, CASE mode WHEN 'SCALP' THEN 1.0 WHEN 'AGGRESSIVE_SCALP' THEN 2.0 ELSE 0.5 END AS l FROM ntq)""")
def _(spark, d):
    x = _two_sided(spark, d)
    chosen = F.when(F.col("direction") == "LONG", F.col("realized_r")).otherwise(F.col("other_r"))
    return x.withColumn("regret", P.regret("realized_r", "other_r", chosen, F.col("confidence") / 100, "fee_r",
                                           "saved_loss_r", "missed_opportunity_r", "mode"))


@query("P32_reliability_label", "symbol mode source n! label label2", """
SELECT *, CASE WHEN n < 120 THEN 'LOW_SAMPLE' WHEN n < 240 THEN 'BUILDING_SAMPLE' ELSE 'STABLE' END AS label,
       CASE WHEN n < 60 THEN 'LOW_SAMPLE' WHEN n < 120 THEN 'BUILDING_SAMPLE' WHEN n < 240 THEN 'MIXED' ELSE 'STABLE' END AS label2
FROM (SELECT symbol, mode, source, count(*) AS n FROM trades GROUP BY ALL)""")
def _(spark, d):
    g = S.trades(spark, d).groupBy("symbol", "mode", "source").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumns({"label": P.reliability("n", F.lit(120)), "label2": P.component_reliability("n", 120)})


cte("ts_t", """
SELECT *, (epoch(closed_at) - epoch(opened_at)) / 60 AS hold_minutes FROM trades""")
cte("ts_e", "SELECT *, (hold_minutes - expected_candles * interval_minutes) / greatest(expected_candles * interval_minutes, 1) AS err FROM ts_t")


def with_hold(t):
    t = t.withColumn("hold_minutes", (F.unix_seconds("closed_at") - F.unix_seconds("opened_at")) / 60.0)
    e = F.col("expected_candles") * F.col("interval_minutes")
    return t.withColumn("error_ratio", (F.col("hold_minutes") - e) / F.greatest(e, F.lit(1.0)))


@query("P33_time_stop_cause", "order_id cause", """
SELECT order_id, CASE WHEN hold_minutes <= greatest(interval_minutes, 1) * 0.75 AND realized_r <= 0.15 THEN 'never_developed' WHEN realized_r <= -0.4 THEN 'late_reversal'
  WHEN err > 0.25 AND realized_r <= 0.1 THEN 'stale_range_bound_hold' WHEN abs(realized_r) <= 0.2 THEN 'stale_range_bound_hold' WHEN realized_r < 0 THEN 'slow_drift' ELSE 'never_developed' END AS cause FROM ts_e""")
def _(spark, d):
    return with_hold(S.trades(spark, d)).withColumn("cause", P.time_stop_cause("realized_r", "error_ratio", "hold_minutes", "interval_minutes"))


cte("fails", """
SELECT order_id, mode, symbol, realized_r, confidence / 100 AS confidence, closed_at AS created_at,
 CASE WHEN close_reason = 'HIT_SL' THEN CASE WHEN late THEN 'TIMING' WHEN sa > 0 AND sa < 1.1 THEN 'RISK_MODEL' WHEN regime = 'HIGH_VOL' THEN 'MARKET_CONDITION' ELSE 'RISK_MODEL' END
   WHEN close_reason IN ('TIME_STOP', 'EARLY_STALE_EXIT') THEN 'TIMING' ELSE 'SIGNAL_QUALITY' END AS failure_source,
 CASE WHEN close_reason = 'HIT_SL' THEN CASE WHEN late THEN 'Entry Logic' ELSE 'Stop Loss' END WHEN close_reason IN ('TIME_STOP', 'EARLY_STALE_EXIT') THEN 'Entry Logic'
   WHEN (direction = 'LONG' AND trend = 'BEARISH') OR (direction = 'SHORT' AND trend = 'BULLISH') THEN 'Trend Filter' ELSE 'MACD' END AS blamed_component,
 CASE WHEN close_reason = 'HIT_SL' THEN CASE WHEN late THEN 'ENTRY_TOO_LATE' WHEN sa > 0 AND sa < 1.1 THEN 'STOP_TOO_TIGHT' ELSE 'STOP_STRUCTURALLY_WRONG' END
   WHEN close_reason = 'EARLY_STALE_EXIT' THEN 'EARLY_STALE_EXIT' WHEN close_reason = 'TIME_STOP' THEN CASE WHEN realized_r <= -0.4 THEN 'LATE_REVERSAL' WHEN abs(realized_r) <= 0.2 THEN 'STALE_RANGE_HOLD' WHEN realized_r < 0 THEN 'SLOW_DRIFT' ELSE 'NEVER_DEVELOPED' END
   WHEN (direction = 'LONG' AND trend = 'BEARISH') OR (direction = 'SHORT' AND trend = 'BULLISH') THEN 'WRONG_DIRECTION' ELSE 'WEAK_CONFIRMATION' END AS classification,
 CASE WHEN realized_r <= -2 THEN 5 WHEN realized_r <= -1.5 THEN 4 WHEN realized_r <= -1 THEN 3 ELSE 2 END + CASE WHEN realized_r <= -0.6 THEN 2 WHEN realized_r <= -0.3 THEN 1 ELSE 0 END AS severity_score
FROM (SELECT *, fee_r >= 0.07 AS late, notional_k / 50 AS sa, CASE WHEN notional_k > 60 THEN 'BULLISH' WHEN notional_k < 20 THEN 'BEARISH' ELSE 'MIXED' END AS trend FROM trades WHERE realized_r <= 0)""")


def failures(spark, d):
    t = S.trades(spark, d).filter("realized_r <= 0")
    k = F.col("notional_k")
    trend = F.when(k > 60, "BULLISH").when(k < 20, "BEARISH").otherwise("MIXED")
    f = P.failure_record("close_reason", "realized_r", "direction", trend, "regime", F.col("fee_r") >= 0.07, k / 50)
    x = t.withColumns(f).withColumns({"created_at": F.col("closed_at"), "confidence": F.col("confidence") / 100})
    # small losses only: spread the severities for the reports
    return x.withColumn("severity_score", F.col("severity_score") + F.when(F.col("realized_r") <= -0.6, 2)
                        .when(F.col("realized_r") <= -0.3, 1).otherwise(0))


@query("P34_failure_record", "order_id failure_source blamed_component classification severity_score!", "SELECT * FROM fails")
def _(spark, d):
    return failures(spark, d)


@query("P35_signal_feature_vector", "event_id! k! bucket outcome_label", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat(event_type, '|', CAST(json_extract_string(props, '$.k') AS BIGINT) // 10) AS bucket,
       CASE WHEN value > 60 THEN 'WIN' WHEN value < 60 THEN 'LOSS' ELSE 'FLAT' END AS outcome_label FROM events""")
def _(spark, d):
    e = S.load(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.select("event_id", "p.k", F.concat_ws("|", "event_type", F.floor(F.col("p.k") / 10).cast("string")).alias("bucket"),
                    P.outcome_label(F.col("value") - 60).alias("outcome_label"))


@query("P36_orderbook_snapshot", "symbol ts@ best_bid#2 best_ask#2 spread_bps# imbalance# microprice_deviation_bps#", """
SELECT symbol, ts, low AS best_bid, high AS best_ask, (high - low) / mid * 10000 AS spread_bps, (bd - ad) / (bd + ad) AS imbalance, ((high * bd + low * ad) / (bd + ad) - mid) / mid * 10000 AS microprice_deviation_bps
FROM (SELECT symbol, ts, low, high, (low + high) / 2 AS mid, taker_buy_volume + 1 + trade_count AS bd, volume - taker_buy_volume + 1 + 2 AS ad FROM bars_4h)""")
def _(spark, d):
    def levels(price, q1, q2, sign):
        return F.array(F.struct(F.col(price).alias("price"), q1.cast("double").alias("qty")),
                       F.struct((F.col(price) * (1 + sign * 0.001)).alias("price"), q2.cast("double").alias("qty")))
    b = S.bars(spark, d)
    bids = levels("low", F.col("taker_buy_volume") + 1, F.col("trade_count"), -1)
    asks = levels("high", F.col("volume") - F.col("taker_buy_volume") + 1, F.lit(2), 1)
    return b.withColumns(P.orderbook_snapshot(bids, asks))
