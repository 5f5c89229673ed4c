"""Queries: trade analytics (A*), ranking (K*), sets and scalar helpers (U*, G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions import bars as B, trading as P
from barlens.functions.core import div
from barlens.operators import quality as Q, ranking as K, trades as A
from barlens.queries.joins_q import bar_labels, failures, with_hold
from barlens.queries.registry import cte, query
from barlens.sources import tables as S


def T(spark, d):
    return S.trades(spark, d)


def TH(spark, d):
    t = with_hold(T(spark, d))
    label, _ = B.session_label(F.col("opened_at"))
    return t.withColumns({"session": label, "hour": F.hour("opened_at"),
                          "components": F.array_compact(F.array(
                              F.concat(F.lit("m_"), "mode"), F.concat(F.lit("s_"), "source"), F.when(F.col("fee_r") > 0.04, F.lit("high_fee"))))})


cte("tt", """
SELECT *, CASE WHEN h < 7 THEN 'ASIA' WHEN h < 12 THEN 'LONDON' WHEN h < 16 THEN 'LONDON_NEW_YORK_OVERLAP' WHEN h < 21 THEN 'NEW_YORK' ELSE 'OFF_HOURS' END AS session, h AS hour,
  list_filter([concat('m_', mode), concat('s_', source), CASE WHEN fee_r > 0.04 THEN 'high_fee' END], lambda x: x IS NOT NULL) AS components FROM (SELECT *, hour(opened_at) AS h FROM ts_e)""")

_ST = """count(*) AS trades, count(CASE WHEN realized_r > 0 THEN 1 END) AS wins, count(CASE WHEN realized_r <= 0 THEN 1 END) AS losses, avg(CASE WHEN realized_r > 0 THEN 100.0 ELSE 0 END) AS win_rate, avg(realized_r) AS avg_r,
 coalesce(avg(realized_r) FILTER (WHERE realized_r > 0), 0) AS avg_win, abs(coalesce(avg(realized_r) FILTER (WHERE realized_r <= 0), 0)) AS avg_loss,
 sum(greatest(realized_r, 0)) / nullif(abs(sum(least(realized_r, 0))), 0) AS profit_factor, sum(greatest(realized_r, 0)) AS gross_profit_r, abs(sum(least(realized_r, 0))) AS gross_loss_r, sum(realized_r) AS net_r, avg(realized_r) AS expectancy"""
_STC = "trades! wins! losses! win_rate#4 avg_r# avg_win# avg_loss# profit_factor# gross_profit_r#3 gross_loss_r#3 net_r#3 expectancy#"


@query("A1_tick_features", "symbol ts@ n! volume#2 buy_volume#2 sell_volume#2 imbalance# large_share# vwap# vwap_deviation# ret_std# first_ts@ last_ts@", """
SELECT t.symbol, b AS ts, count(*) AS n, sum(size) AS volume, sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) AS buy_volume, sum(CASE WHEN side = 'sell' THEN size ELSE 0 END) AS sell_volume,
  (sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) - sum(CASE WHEN side = 'sell' THEN size ELSE 0 END)) / nullif(sum(size), 0) AS imbalance, avg(CASE WHEN size > 2 * med THEN 1.0 ELSE 0 END) AS large_share,
  sum(price * size) / sum(size) AS vwap, sum(price * size) / sum(size) / nullif(arg_min(price, (ts, event_id)), 0) - 1 AS vwap_deviation, stddev_samp(price / nullif(pp, 0) - 1) AS ret_std, min(ts) AS first_ts, max(ts) AS last_ts
FROM (SELECT *, median(size) OVER (PARTITION BY symbol, b) AS med, lag(price) OVER (PARTITION BY symbol, b ORDER BY ts, event_id) AS pp FROM (SELECT *, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS b FROM ticks)) t GROUP BY 1, 2""")
def _(spark, d):
    from barlens.operators.ticks import tick_features
    return tick_features(S.ticks(spark, d), "4 hours")


@query("A2_aggtrade_features", "symbol ts_start@ ts_available@ mean_price# std_price# qty#2 trades! maker_share# imbalance# burst_z#", """
SELECT symbol, b AS ts_start, b + INTERVAL '4 hours' AS ts_available, mp AS mean_price, sp AS std_price, qty, n AS trades, mk AS maker_share, im AS imbalance, (n - avg(n) OVER ()) / nullif(stddev_samp(n) OVER (), 0) AS burst_z FROM (
SELECT symbol, b, avg(price) AS mp, stddev_samp(price) AS sp, sum(size) AS qty, count(*) AS n, avg(CASE WHEN side = 'sell' THEN 1.0 ELSE 0 END) AS mk,
  sum(CASE WHEN side = 'buy' THEN size ELSE -size END) / sum(size) AS im FROM (SELECT *, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS b FROM ticks) GROUP BY 1, 2)""")
def _(spark, d):
    from barlens.operators.ticks import aggtrade_features
    return aggtrade_features(S.ticks(spark, d), "4 hours")


@query("A3_trade_stats", _STC, f"SELECT {_ST} FROM trades")
def _(spark, d):
    return A.trade_stats(T(spark, d))


_DIMS = ["regime", "mode", "symbol", "interval", "direction", "source", "close_reason"]


@query("A4_trade_stats_by", "dim label " + _STC, f"SELECT 'ALL' AS dim, 'ALL' AS label, {_ST} FROM trades" + "".join(
    f" UNION ALL SELECT '{x}', {x}, {_ST} FROM trades GROUP BY {x}" for x in _DIMS))
def _(spark, d):
    return A.trade_stats_by(T(spark, d), _DIMS)


_GD = ["mode", "regime", "session", "direction"]
cte("gm", " UNION ALL ".join(f"""
SELECT *, avg_realized_r * sqrt(trades::DOUBLE) AS expectancy_score, CASE WHEN trades < 10 THEN 'LOW_SAMPLE' WHEN trades < 20 THEN 'BUILDING_SAMPLE' ELSE 'STABLE' END AS reliability, trades < 10 AS provisional FROM (
SELECT '{x}' AS dim, {x} AS label, count(*) AS trades, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(realized_r) AS avg_realized_r, sum(realized_r) AS net_r, sum(greatest(realized_r, 0)) / nullif(abs(sum(least(realized_r, 0))), 0) AS profit_factor,
  avg(hold_minutes) AS avg_hold_minutes, avg(CASE WHEN close_reason = 'HIT_SL' THEN 1.0 ELSE 0 END) AS stop_hit_pct, avg(CASE WHEN close_reason = 'HIT_TP' THEN 1.0 ELSE 0 END) AS target_hit_pct, avg(CASE WHEN close_reason = 'TIME_STOP' THEN 1.0 ELSE 0 END) AS time_exit_pct, max(dd) AS max_drawdown_r
FROM (SELECT *, greatest(0, max(e) OVER (PARTITION BY {x} ORDER BY closed_at, order_id ROWS UNBOUNDED PRECEDING)) - e AS dd FROM (SELECT *, sum(realized_r) OVER (PARTITION BY {x} ORDER BY closed_at, order_id ROWS UNBOUNDED PRECEDING) AS e FROM tt)) GROUP BY {x})""" for x in _GD))
_GMC = "dim label trades! win_rate# avg_realized_r# net_r#3 profit_factor# avg_hold_minutes#2 stop_hit_pct# target_hit_pct# time_exit_pct# max_drawdown_r#3 expectancy_score#4 reliability provisional?"


@query("A5_group_metrics", _GMC, "SELECT * FROM gm")
def _(spark, d):
    return A.group_metrics(TH(spark, d), _GD)


@query("A6_leaderboard_by", "dim label rank! trades! expectancy_score#4", """
SELECT *, row_number() OVER (PARTITION BY dim ORDER BY provisional, CASE WHEN NOT provisional THEN expectancy_score END DESC NULLS LAST, CASE WHEN provisional THEN trades END DESC NULLS LAST, label) AS rank FROM gm""")
def _(spark, d):
    return A.leaderboard_by(A.group_metrics(TH(spark, d), _GD))


@query("A7_boards", "dim label best_rank! worst_rank! avg_realized_r#", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY expectancy_score DESC, label) AS best_rank, row_number() OVER (PARTITION BY dim ORDER BY expectancy_score, label DESC) AS worst_rank FROM gm WHERE NOT provisional) WHERE best_rank <= 2 OR worst_rank <= 2""")
def _(spark, d):
    return A.boards(A.group_metrics(TH(spark, d), _GD), 2)


@query("A8_session_hour_heatmap", "session " + " ".join(f"h{h:02d}!" for h in range(24)), "SELECT session, " + ", ".join(
    f"count(CASE WHEN hour = {h} THEN 1 END) AS h{h:02d}" for h in range(24)) + " FROM tt GROUP BY session")
def _(spark, d):
    return A.session_hour_heatmap(TH(spark, d), "session", "hour")


cte("cb", "SELECT least(90, floor(confidence / 10) * 10)::INT AS bucket, count(*) AS trades, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(realized_r) AS avg_realized_r, avg(confidence) AS avg_confidence FROM trades GROUP BY 1")


@query("A9_confidence_buckets", "bucket! trades! win_rate# avg_realized_r# avg_confidence#", "SELECT * FROM cb")
def _(spark, d):
    return A.confidence_buckets(T(spark, d))


@query("A9_confidence_monotonicity", "pairs! score# status", """
SELECT *, CASE WHEN score >= 0.75 THEN 'PASS' WHEN score >= 0.5 THEN 'MIXED' ELSE 'FAILED' END AS status FROM (SELECT count(p) AS pairs, avg(CASE WHEN avg_realized_r >= p THEN 1.0 ELSE 0 END) FILTER (WHERE p IS NOT NULL) AS score FROM (SELECT *, lag(avg_realized_r) OVER (ORDER BY bucket) AS p FROM cb))""")
def _(spark, d):
    return A.confidence_monotonicity(A.confidence_buckets(T(spark, d)))


_TS = "count(*) AS time_stops, avg(hold_minutes) AS avg_hold_minutes, avg(realized_r) AS avg_realized_r, avg(err) AS duration_error, avg(abs(err)) AS duration_error_abs, avg(CASE WHEN abs(err) <= 0.25 THEN 1.0 ELSE 0 END) AS within_25pct, avg(CASE WHEN err > 0.25 THEN 1.0 ELSE 0 END) AS overrun_rate, avg(CASE WHEN err < -0.25 THEN 1.0 ELSE 0 END) AS underrun_rate"


@query("A10_time_stop_analysis", "dim label time_stops! avg_hold_minutes#2 avg_realized_r# duration_error#3 duration_error_abs#3 within_25pct# overrun_rate# underrun_rate#",
       f"SELECT 'ALL' AS dim, 'ALL' AS label, {_TS} FROM tt WHERE close_reason = 'TIME_STOP'" + "".join(f" UNION ALL SELECT '{x}', {x}, {_TS} FROM tt WHERE close_reason = 'TIME_STOP' GROUP BY {x}" for x in ("mode", "interval", "session")))
def _(spark, d):
    return A.time_stop_analysis(TH(spark, d), ["mode", "interval", "session"])


_RD = "count(*) AS trades, " + ", ".join(f"avg(CASE WHEN close_reason = '{v}' THEN 1.0 ELSE 0 END) AS {n}_rate, coalesce(avg(realized_r) FILTER (WHERE close_reason = '{v}'), 0) AS {n}_avg_r" for n, v in (("stop", "HIT_SL"), ("time", "TIME_STOP"), ("stale", "EARLY_STALE_EXIT")))


@query("A11_rate_dashboards", "dim label trades! stop_rate# stop_avg_r# time_rate# time_avg_r# stale_rate# stale_avg_r#",
       f"SELECT 'ALL' AS dim, 'ALL' AS label, {_RD} FROM tt" + "".join(f" UNION ALL SELECT '{x}', {x}, {_RD} FROM tt GROUP BY {x}" for x in ("mode", "interval", "session", "regime", "source")))
def _(spark, d):
    return A.rate_dashboards(TH(spark, d), ["mode", "interval", "session", "regime", "source"])


@query("A12_period_comparison", "symbol trades_now! trades_prior! avg_r_now# avg_r_prior# delta_avg_r# verdict", """
SELECT *, CASE WHEN trades_prior < 10 THEN 'emerging' WHEN delta_avg_r > 0.2 THEN 'improving' WHEN delta_avg_r < -0.2 AND avg_r_prior > 0 AND avg_r_now < 0 THEN 'worsening' WHEN delta_avg_r < -0.2 THEN 'decaying' ELSE 'steady' END AS verdict FROM (
SELECT *, CASE WHEN trades_prior >= 10 THEN avg_r_now - avg_r_prior END AS delta_avg_r FROM (
SELECT symbol, count(CASE WHEN closed_at >= TIMESTAMP '2000-07-05' THEN 1 END) AS trades_now, count(CASE WHEN closed_at < TIMESTAMP '2000-07-05' THEN 1 END) AS trades_prior, avg(realized_r) FILTER (WHERE closed_at >= TIMESTAMP '2000-07-05') AS avg_r_now, avg(realized_r) FILTER (WHERE closed_at < TIMESTAMP '2000-07-05') AS avg_r_prior
FROM trades WHERE closed_at >= TIMESTAMP '2000-01-07' GROUP BY symbol) WHERE trades_now >= 10)""")
def _(spark, d):
    return A.period_comparison(T(spark, d), "symbol", F.lit("2001-01-01").cast("timestamp"), 180)


@query("A13_failure_breakdown", "dim label count! percent#4", " UNION ALL ".join(
    f"SELECT '{x}' AS dim, {x} AS label, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM fails) AS percent FROM fails GROUP BY {x}" for x in ("failure_source", "blamed_component", "classification")))
def _(spark, d):
    f = failures(spark, d)
    out = None
    for x in ("failure_source", "blamed_component", "classification"):
        g = A.failure_breakdown(f, x).withColumn("dim", F.lit(x))
        out = g if out is None else out.unionByName(g)
    return out


@query("A13_source_component_matrix", "failure_source blamed_component count! level!", """
SELECT coalesce(failure_source, 'ALL') AS failure_source, coalesce(blamed_component, 'ALL') AS blamed_component, count(*) AS count, grouping(failure_source) * 2 + grouping(blamed_component) AS level FROM fails GROUP BY CUBE (failure_source, blamed_component)""")
def _(spark, d):
    return A.source_component_matrix(failures(spark, d))


@query("A13_severity_histogram", "severity! count! percent#4", """
SELECT s AS severity, count(f.order_id) AS count, count(f.order_id) * 100.0 / (SELECT count(*) FROM fails) AS percent FROM (SELECT unnest(range(1, 6)) AS s) LEFT JOIN fails f ON greatest(1, least(5, f.severity_score)) = s GROUP BY s""")
def _(spark, d):
    return A.severity_histogram(failures(spark, d))


@query("A13_ranked_improvements", "failure_source blamed_component count! avg_severity# avg_confidence# weight_score#2 improvement", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(improvement) ORDER BY weight_score DESC, failure_source, blamed_component) AS kk FROM (
SELECT failure_source, blamed_component, count(*) AS count, avg(severity_score) AS avg_severity, avg(confidence) AS avg_confidence, count(*) * avg(severity_score) AS weight_score, arg_max(classification, (confidence, order_id)) AS improvement FROM fails GROUP BY 1, 2)) WHERE kk = 1""")
def _(spark, d):
    return A.ranked_improvements(failures(spark, d))


@query("A14_weakness_profile", "failure_source count! avg_severity# weight_score#2 top_component best_improvement", """
SELECT g.*, t.top_component FROM (SELECT failure_source, count(*) AS count, avg(severity_score) AS avg_severity, count(*) * avg(severity_score) AS weight_score, arg_max(classification, (confidence, order_id)) AS best_improvement FROM fails WHERE confidence >= 0.6 GROUP BY 1) g
JOIN (SELECT failure_source, arg_max(blamed_component, (w, blamed_component)) AS top_component FROM (SELECT failure_source, blamed_component, sum(severity_score) AS w FROM fails WHERE confidence >= 0.6 GROUP BY 1, 2) GROUP BY 1) t USING (failure_source)""")
def _(spark, d):
    return A.weakness_profile(failures(spark, d))


def _components_sql(source, groups):
    return f"""
SELECT {source} AS failure_source, blamed_component, count(*) AS count, avg(severity_score) AS avg_severity, avg(confidence) AS avg_confidence, count(*) * avg(severity_score) AS weight_score, arg_max(classification, (confidence, order_id)) AS best_improvement FROM fails WHERE confidence >= 0.6 GROUP BY {groups}"""


@query("A14_weakness_components", "failure_source blamed_component count! avg_severity# avg_confidence# weight_score#2 top_source best_improvement place!", f"""
SELECT c.*, CASE WHEN c.failure_source = 'ALL' THEN m.top ELSE c.failure_source END AS top_source, row_number() OVER (PARTITION BY c.failure_source ORDER BY weight_score DESC, blamed_component) AS place
FROM ({_components_sql("'ALL'", 'blamed_component')} UNION ALL {_components_sql('failure_source', 'failure_source, blamed_component')}) c
JOIN (SELECT blamed_component, arg_max(failure_source, (n, failure_source)) AS top FROM (SELECT blamed_component, failure_source, count(*) AS n FROM fails WHERE confidence >= 0.6 GROUP BY 1, 2) GROUP BY 1) m USING (blamed_component)""")
def _(spark, d):
    return A.weakness_components(failures(spark, d))


cte("tc", "SELECT *, unnest(components) AS component FROM tt")


@query("A15_component_impact", "component trades! win_rate# avg_realized_r# net_r#3 profit_factor# stop_hit_pct# max_drawdown_r#3 expectancy_delta# confidence_delta#4 sample_reliability", """
SELECT component, count(*) AS trades, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(realized_r) AS avg_realized_r, sum(realized_r) AS net_r, sum(greatest(realized_r, 0)) / abs(sum(least(realized_r, 0))) AS profit_factor, avg(CASE WHEN close_reason = 'HIT_SL' THEN 1.0 ELSE 0 END) AS stop_hit_pct,
  max(dd) AS max_drawdown_r, avg(realized_r) - (SELECT avg(realized_r) FROM tc) AS expectancy_delta, avg(confidence) - (SELECT avg(confidence) FROM tc) AS confidence_delta, 'STABLE' AS sample_reliability
FROM (SELECT *, greatest(0, max(e) OVER w) - e AS dd FROM (SELECT *, sum(realized_r) OVER (PARTITION BY component ORDER BY closed_at, order_id ROWS UNBOUNDED PRECEDING) AS e FROM tc) WINDOW w AS (PARTITION BY component ORDER BY closed_at, order_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1""")
def _(spark, d):
    return A.component_impact(TH(spark, d))


@query("A15_combination_impact", "label trades! avg_realized_r#", """
SELECT array_to_string(list_sort(components)[1:3], ' + ') AS label, count(*) AS trades, avg(realized_r) AS avg_realized_r FROM tt WHERE len(components) >= 2 GROUP BY 1""")
def _(spark, d):
    return A.combination_impact(TH(spark, d))


@query("A15_change_impact", "component trades_before! trades_after! avg_r_before# avg_r_after# expectancy_delta#", """
SELECT *, avg_r_after - avg_r_before AS expectancy_delta FROM (SELECT component, count(CASE WHEN closed_at < TIMESTAMP '1999-01-01' THEN 1 END) AS trades_before, count(CASE WHEN closed_at >= TIMESTAMP '1999-01-01' THEN 1 END) AS trades_after,
  coalesce(avg(realized_r) FILTER (WHERE closed_at < TIMESTAMP '1999-01-01'), 0) AS avg_r_before, coalesce(avg(realized_r) FILTER (WHERE closed_at >= TIMESTAMP '1999-01-01'), 0) AS avg_r_after FROM tc GROUP BY 1)""")
def _(spark, d):
    return A.change_impact(TH(spark, d), F.lit("1999-01-01").cast("timestamp"))


@query("A16_confidence_weights", "symbol mode role weight#", """
SELECT symbol, mode, role, v / nullif(sum(v) OVER (PARTITION BY symbol, mode), 0) AS weight FROM (
SELECT symbol, mode, role, avg(greatest(realized_r, 0) * greatest(abs(score), 0.05) * greatest(weight, 0.1)) AS v FROM (
SELECT symbol, mode, realized_r, 'TREND' AS role, confidence / 100 AS score, 1.5 AS weight FROM trades UNION ALL SELECT symbol, mode, realized_r, 'MOMENTUM', fee_r, expected_candles / 10 FROM trades UNION ALL SELECT symbol, mode, realized_r, 'VOLUME', 0.3, 1.0 FROM trades WHERE confidence >= 30) GROUP BY 1, 2, 3)""")
def _(spark, d):
    def f(role, score, weight, used=F.lit(True)):
        return F.struct(F.lit(role).alias("role"), score.cast("double").alias("score"), weight.cast("double").alias("weight"), used.alias("used"))
    t = T(spark, d).withColumn("factors_json", F.to_json(F.array(
        f("trend", F.col("confidence") / 100, F.lit(1.5)), f("momentum", F.col("fee_r"), F.col("expected_candles") / 10),
        f("volume", F.lit(0.3), F.lit(1.0), F.col("confidence") >= 30))))
    return A.confidence_weights(t, ["symbol", "mode"])


@query("A17_learning_multiplier", "symbol mode regime direction interval confidence#2 multiplier#2 sample_size! scope", """
SELECT r.*, CASE WHEN b IS NULL THEN 1.0 WHEN b.wr >= 65 AND b.pf >= 1.4 THEN 1.2 WHEN b.wr >= 58 AND b.pf >= 1.1 THEN 1.1 WHEN b.wr <= 40 OR b.pf < 0.8 THEN 0.75 WHEN b.wr <= 48 OR b.pf < 1 THEN 0.9 ELSE 1.0 END AS multiplier, coalesce(b.n, 0) AS sample_size, coalesce(b.scope, 'none') AS scope FROM (
SELECT q.symbol, q.mode, q.regime, q.direction, q.interval, q.confidence, coalesce(e.s, g.s, m.s, y.s) AS b FROM lreq q
LEFT JOIN (SELECT symbol, interval, mode, direction, regime, band, {'n': count(*), 'wr': avg(CASE WHEN realized_r > 0 THEN 100.0 ELSE 0 END), 'pf': CASE WHEN sum(least(realized_r, 0)) < 0 THEN sum(greatest(realized_r, 0)) / abs(sum(least(realized_r, 0))) ELSE sum(greatest(realized_r, 0)) END, 'scope': 'EXACT'} AS s FROM tband GROUP BY ALL HAVING count(*) >= 60) e ON e.symbol = q.symbol AND e.interval = q.interval AND e.mode = q.mode AND e.direction = q.direction AND e.regime = q.regime AND e.band = q.band
LEFT JOIN (SELECT regime, {'n': count(*), 'wr': avg(CASE WHEN realized_r > 0 THEN 100.0 ELSE 0 END), 'pf': sum(greatest(realized_r, 0)) / abs(sum(least(realized_r, 0))), 'scope': 'REGIME'} AS s FROM tband GROUP BY ALL HAVING count(*) >= 60) g ON g.regime = q.regime
LEFT JOIN (SELECT mode, {'n': count(*), 'wr': avg(CASE WHEN realized_r > 0 THEN 100.0 ELSE 0 END), 'pf': sum(greatest(realized_r, 0)) / abs(sum(least(realized_r, 0))), 'scope': 'MODE'} AS s FROM tband GROUP BY ALL HAVING count(*) >= 60) m ON m.mode = q.mode
LEFT JOIN (SELECT symbol, {'n': count(*), 'wr': avg(CASE WHEN realized_r > 0 THEN 100.0 ELSE 0 END), 'pf': sum(greatest(realized_r, 0)) / abs(sum(least(realized_r, 0))), 'scope': 'SYMBOL'} AS s FROM tband GROUP BY ALL HAVING count(*) >= 60) y ON y.symbol = q.symbol) r""",
       tband="SELECT *, CASE WHEN confidence < 40 THEN '0-40' WHEN confidence < 60 THEN '40-60' WHEN confidence < 80 THEN '60-80' ELSE '80-100' END AS band FROM trades",
       lreq="SELECT DISTINCT symbol, mode, regime, direction, interval, confidence, band FROM tband")
def _(spark, d):
    t = T(spark, d)
    req = t.select("symbol", "mode", "regime", "direction", "interval", "confidence").distinct()
    return A.learning_multiplier(t, req, 60)


@query("A18_timing_summary", "mode count! avg# min#2 max#2 total#2 p50#4 p95#4 p99#4", """
SELECT mode, count(*) AS count, avg(hold_minutes) AS avg, min(hold_minutes) AS min, max(hold_minutes) AS max, sum(hold_minutes) AS total, quantile_cont(hold_minutes, 0.5) AS p50, quantile_cont(hold_minutes, 0.95) AS p95, quantile_cont(hold_minutes, 0.99) AS p99 FROM tt GROUP BY mode""")
def _(spark, d):
    return A.timing_summary(TH(spark, d), ["mode"], "hold_minutes")


@query("A19_daily_performance", "day@ trades! net_r#4 win_rate# equity#3 drawdown#3", """
SELECT day, trades, net_r, win_rate, e AS equity, greatest(0, max(e) OVER (ORDER BY day)) - e AS drawdown FROM (SELECT *, sum(net_r) OVER (ORDER BY day) AS e FROM (SELECT date_trunc('day', closed_at) AS day, count(*) AS trades, sum(realized_r) AS net_r, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM trades GROUP BY 1))""")
def _(spark, d):
    return A.daily_performance(T(spark, d))


@query("A20_profitability", "mode trades! total_net_r#3 avg_net_r# median_net_r# profit_factor# win_rate# sharpe#4 max_drawdown_r#3 calmar#6 total_fee_r#3 total_gross_r#3 stop_pct# target_pct# dominant_share#", """
SELECT g.*, s.dominant_share, total_net_r / trades / sd * sqrt(252.0::DOUBLE) AS sharpe, total_net_r / trades / max_drawdown_r AS calmar FROM (
SELECT mode, count(*) AS trades, sum(realized_r) AS total_net_r, avg(realized_r) AS avg_net_r, median(realized_r) AS median_net_r, sum(greatest(realized_r, 0)) / abs(sum(least(realized_r, 0))) AS profit_factor, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) AS win_rate, stddev_samp(realized_r) AS sd,
  sum(fee_r) AS total_fee_r, sum(realized_r + fee_r) AS total_gross_r, avg(CASE WHEN close_reason = 'HIT_SL' THEN 1.0 ELSE 0 END) AS stop_pct, avg(CASE WHEN close_reason = 'HIT_TP' THEN 1.0 ELSE 0 END) AS target_pct, max(dd) AS max_drawdown_r
FROM (SELECT *, greatest(0, max(equity) OVER (PARTITION BY mode ORDER BY closed_at, order_id ROWS UNBOUNDED PRECEDING)) - equity AS dd FROM eqm) GROUP BY mode) g
JOIN (SELECT mode, max(abs(s)) / sum(abs(s)) AS dominant_share FROM (SELECT mode, symbol, sum(realized_r) AS s FROM trades GROUP BY 1, 2) GROUP BY 1) s USING (mode)""")
def _(spark, d):
    return A.profitability(T(spark, d), ["mode"])


query("A21_trade_aggregate", "mode source " + _STC, f"SELECT mode, source, {_ST} FROM trades GROUP BY ALL")(
    lambda spark, d: T(spark, d).groupBy("mode", "source").agg(*A.stats()))


@query("A22_fold_metrics", "fold! n! expectancy# sharpe#4 profit_factor# win_rate# fee#4 net_r#4", """
SELECT *, 0 AS z FROM (SELECT fold, count(*) AS n, avg(realized_r) AS expectancy, avg(realized_r) / stddev_samp(realized_r) * sqrt(252.0::DOUBLE) AS sharpe, sum(greatest(realized_r, 0)) / abs(sum(least(realized_r, 0))) AS profit_factor, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) AS win_rate,
  sum(abs(realized_r) * 0.0004) AS fee, sum(realized_r - abs(realized_r) * 0.0007) AS net_r FROM preds GROUP BY fold)""")
def _(spark, d):
    p = S.predictions(spark, d)
    x = p.withColumns({k: v for k, v in A.cost_decomposition("realized_r", 0.0004, 0.0002, 0.0001).items() if k in ("fee", "net_r")})
    return A.fold_metrics(p, ["fold"], "realized_r").join(x.groupBy("fold").agg(F.sum("fee").alias("fee"), F.sum("net_r").alias("net_r")), "fold")


cte("acts", "SELECT *, CASE WHEN p >= 0.6 THEN 'LONG_NOW' WHEN p < 0.3 THEN 'SHORT_NOW' ELSE 'NO_TRADE' END AS action, CASE WHEN y = 1 THEN 'LONG_NOW' WHEN y2 = 1 THEN 'NO_TRADE' ELSE 'SHORT_NOW' END AS truth FROM preds")


def actions(spark, d):
    p = F.col("p")
    return S.predictions(spark, d).withColumns({
        "action": F.when(p >= 0.6, "LONG_NOW").when(p < 0.3, "SHORT_NOW").otherwise("NO_TRADE"),
        "truth": F.when(F.col("y") == 1, "LONG_NOW").when(F.col("y2") == 1, "NO_TRADE").otherwise("SHORT_NOW")})


@query("A23_economic_metrics", "fold! active_trades! long_trades! short_trades! no_trades! total_gross_r#4 total_fee_r#4 total_slippage_r#4 total_net_r#4 avg_net_r_active# avg_net_r_decision# exposure_pct#4", """
SELECT *, g AS total_gross_r, a AS active_trades, a * 0.05 AS total_fee_r, a * 0.01 AS total_slippage_r, g - a * 0.06 AS total_net_r, (g - a * 0.06) / nullif(a, 0) AS avg_net_r_active, (g - a * 0.06) / n AS avg_net_r_decision, a * 100.0 / n AS exposure_pct FROM (
SELECT fold, count(*) AS n, count(CASE WHEN action <> 'NO_TRADE' THEN 1 END) AS a, count(CASE WHEN action = 'LONG_NOW' THEN 1 END) AS long_trades, count(CASE WHEN action = 'SHORT_NOW' THEN 1 END) AS short_trades, count(CASE WHEN action = 'NO_TRADE' THEN 1 END) AS no_trades, sum(CASE WHEN action <> 'NO_TRADE' THEN realized_r ELSE 0 END) AS g FROM acts GROUP BY fold)""")
def _(spark, d):
    return A.economic_metrics(actions(spark, d), "action", "realized_r", 0.05, 0.01, ["fold"])


@query("A24_concentration", "n_keys! top_key top_share# hhi# top3_share#", """
SELECT count(*) AS n_keys, arg_max(symbol, -k) AS top_key, max(s) AS top_share, sum(s * s) AS hhi, sum(s) FILTER (WHERE k <= 3) AS top3_share FROM (SELECT symbol, n / sum(n) OVER () AS s, row_number() OVER (ORDER BY n DESC, symbol) AS k FROM (SELECT symbol, count(*)::DOUBLE AS n FROM trades GROUP BY 1))""")
def _(spark, d):
    return A.concentration(T(spark, d), "symbol")


@query("A25_regime_breakdown", "regime trades! expectancy# win_rate# sample_pct# is_rare? is_catastrophic?", """
SELECT regime, count(*) AS trades, avg(realized_r) AS expectancy, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) AS win_rate, count(*) / (SELECT count(*) FROM trades) AS sample_pct, count(*) / (SELECT count(*) FROM trades) < 0.05 AS is_rare, avg(realized_r) < -0.5 AS is_catastrophic FROM trades GROUP BY 1""")
def _(spark, d):
    return A.regime_breakdown(T(spark, d))


@query("A25_symbol_regime_matrix", "symbol TREND# RANGE# TRANSITION#", """
SELECT symbol, avg(realized_r) FILTER (WHERE regime = 'TREND') AS "TREND", avg(realized_r) FILTER (WHERE regime = 'RANGE') AS "RANGE", avg(realized_r) FILTER (WHERE regime = 'TRANSITION') AS "TRANSITION" FROM trades GROUP BY 1""")
def _(spark, d):
    return A.symbol_regime_matrix(T(spark, d), ["TREND", "RANGE", "TRANSITION"])


@query("A26_no_trade_trend", "first_half# second_half# max_pct# min_pct# collapse? windows! trend", """
SELECT *, CASE WHEN (second_half - first_half) * 100 > 5 THEN 'increasing' WHEN (second_half - first_half) * 100 < -5 THEN 'decreasing' ELSE 'stable' END AS trend FROM (
SELECT avg(pct) FILTER (WHERE w < n // 2) AS first_half, avg(pct) FILTER (WHERE w >= n // 2) AS second_half, max(pct) AS max_pct, min(pct) AS min_pct, bool_or(pct >= 0.8) AS collapse, count(*) AS windows FROM (SELECT *, count(*) OVER () AS n FROM (
SELECT w, avg(CASE WHEN close_reason = 'EARLY_STALE_EXIT' THEN 1.0 ELSE 0 END) AS pct FROM (SELECT *, (row_number() OVER (ORDER BY closed_at, order_id) - 1) // 500 AS w FROM trades) GROUP BY w)))""")
def _(spark, d):
    t = T(spark, d).withColumn("nt", F.col("close_reason") == "EARLY_STALE_EXIT")
    return A.no_trade_trend(t, A.ORDER, "nt", 500)


@query("A27_counterfactual_no_trade", "fold! no_trades! saved_count! missed_count! saved_r#4 missed_r#4 counterfactual_r#4 saved_missed_ratio#", """
SELECT *, saved_r - missed_r AS counterfactual_r, saved_r / nullif(missed_r, 0) AS saved_missed_ratio FROM (SELECT fold, count(*) AS no_trades, count(CASE WHEN realized_r < 0 THEN 1 END) AS saved_count, count(CASE WHEN realized_r > 0 THEN 1 END) AS missed_count, sum(greatest(-realized_r, 0)) AS saved_r, sum(greatest(realized_r, 0)) AS missed_r FROM acts WHERE action = 'NO_TRADE' GROUP BY fold)""")
def _(spark, d):
    return A.counterfactual_no_trade(actions(spark, d), ["fold"], F.col("action") == "NO_TRADE", "realized_r")


@query("A28_label_distribution", "mode close_reason n! share#", "SELECT mode, close_reason, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY mode) AS share FROM trades GROUP BY 1, 2")
def _(spark, d):
    return A.label_distribution(T(spark, d), "close_reason", "mode")


_NT = """
SELECT *, correct_no_trades / greatest(no_trades, 1) AS correct_rate FROM (SELECT fold, count(*) AS decisions, avg(CASE WHEN action = 'NO_TRADE' THEN 1.0 ELSE 0 END) AS no_trade_rate, count(CASE WHEN action = 'NO_TRADE' THEN 1 END) AS no_trades, count(CASE WHEN action = 'NO_TRADE' AND realized_r < 0 THEN 1 END) AS correct_no_trades,
  sum(CASE WHEN action = 'NO_TRADE' THEN greatest(-realized_r, 0) ELSE 0 END) AS saved_r, sum(CASE WHEN action = 'NO_TRADE' THEN greatest(realized_r, 0) ELSE 0 END) AS missed_r, count(CASE WHEN action = 'NO_TRADE' AND p > 0.5 THEN 1 END) AS over_suppression, count(CASE WHEN action <> 'NO_TRADE' AND realized_r < -1 THEN 1 END) AS under_suppression FROM acts GROUP BY fold)"""
cte("ntp", _NT)


@query("A29_no_trade_patterns", "fold! decisions! no_trade_rate# no_trades! correct_no_trades! saved_r#4 missed_r#4 over_suppression! under_suppression! correct_rate# patterns", """
SELECT *, array_to_string(list_filter([CASE WHEN no_trade_rate > 0.7 THEN 'excessive_no_trade' WHEN no_trade_rate > 0.5 THEN 'elevated_no_trade' END, CASE WHEN correct_rate < 0.4 THEN 'low_correct_rate' END, CASE WHEN missed_r > saved_r * 1.5 AND saved_r > 0 THEN 'net_harmful_avoidance' END, CASE WHEN over_suppression > no_trades * 0.3 THEN 'over_suppression' END], lambda x: x IS NOT NULL), ',') AS patterns FROM ntp""")
def _(spark, d):
    return A.no_trade_patterns(actions(spark, d), ["fold"], "action", "realized_r", "p")


@query("A29_baseline_delta", "fold! no_trade_rate_delta# correct_rate_delta# significant?", """
SELECT a.fold, a.no_trade_rate - b.no_trade_rate AS no_trade_rate_delta, a.correct_rate - b.correct_rate AS correct_rate_delta, abs(a.no_trade_rate - b.no_trade_rate) > 0.1 AS significant FROM ntp a JOIN ntp b ON a.fold = b.fold + 1""")
def _(spark, d):
    n = A.no_trade_patterns(actions(spark, d), ["fold"], "action", "realized_r", "p")
    return A.baseline_delta(n, n.withColumn("fold", F.col("fold") + 1), "fold", ["no_trade_rate", "correct_rate"])


@query("A30_cost_stress", "mode multiplier#2 mean_net_r# mean_change# edge_survives? break_even_multiple#4", """
SELECT mode, m AS multiplier, avg(realized_r - fee_r * (m - 1)) AS mean_net_r, avg(realized_r - fee_r * (m - 1)) - avg(realized_r) AS mean_change, avg(realized_r - fee_r * (m - 1)) > 0 AS edge_survives, CASE WHEN avg(realized_r) > 0 THEN 1 + avg(realized_r) / avg(fee_r) END AS break_even_multiple
FROM trades, (SELECT unnest([1.0, 2.0, 5.0, 10.0]::DOUBLE[]) AS m) GROUP BY 1, 2""")
def _(spark, d):
    return A.cost_stress(T(spark, d), "realized_r", "fee_r", [1, 2, 5, 10], ["mode"])


@query("A31_histogram", "bucket_start#2 count! buy_count! sell_count! below_threshold!", """
SELECT floor(confidence / 5) * 5 AS bucket_start, count(*) AS count, count(CASE WHEN direction = 'LONG' THEN 1 END) AS buy_count, count(CASE WHEN direction = 'SHORT' THEN 1 END) AS sell_count, count(CASE WHEN confidence < 60 THEN 1 END) AS below_threshold FROM trades GROUP BY 1""")
def _(spark, d):
    return A.histogram(T(spark, d), "confidence", 5, 60)


@query("A31_what_if", "threshold#2 included! newly_included! new_symbols! new_avg_r#", """
SELECT t AS threshold, count(CASE WHEN confidence >= t THEN 1 END) AS included, count(CASE WHEN confidence >= t AND confidence < 60 THEN 1 END) AS newly_included, count(DISTINCT CASE WHEN confidence >= t AND confidence < 60 THEN symbol END) AS new_symbols, avg(CASE WHEN confidence >= t AND confidence < 60 THEN realized_r END) AS new_avg_r FROM trades, (SELECT unnest([40.0, 50.0, 70.0]::DOUBLE[]) AS t) GROUP BY 1""")
def _(spark, d):
    return A.what_if(T(spark, d), "confidence", 60, [40, 50, 70])


@query("A32_circuit_state", "failure_rate#4 consecutive_losses! analyzed! avg_severity# active_rules status", """
SELECT failure_rate, consecutive_losses, analyzed, avg_severity, array_to_string(CASE WHEN len(o) > 0 THEN o ELSE d END, ',') AS active_rules, CASE WHEN len(o) > 0 THEN 'OPEN' WHEN len(d) > 0 THEN 'DEGRADED' ELSE 'CLOSED' END AS status FROM (
SELECT *, list_filter([CASE WHEN consecutive_losses >= 6 THEN 'max_consecutive_losses' END, CASE WHEN failure_rate >= 70 AND analyzed >= 3 THEN 'max_failure_rate_pct' END, CASE WHEN avg_severity >= 4 AND f >= 3 THEN 'max_severity_avg' END], lambda x: x IS NOT NULL) AS o,
 list_filter([CASE WHEN failure_rate >= 60 THEN 'near_failure_rate' END, CASE WHEN consecutive_losses >= 5 THEN 'near_consecutive_losses' END, CASE WHEN avg_severity >= 3.5 THEN 'near_severity' END], lambda x: x IS NOT NULL) AS d FROM (
SELECT avg(CASE WHEN i <= 20 THEN CASE WHEN realized_r <= 0 THEN 100.0 ELSE 0 END END) AS failure_rate, coalesce(min(CASE WHEN realized_r > 0 THEN i END), count(*) + 1) - 1 AS consecutive_losses, count(CASE WHEN i <= 20 THEN 1 END) AS analyzed FROM (SELECT *, row_number() OVER (ORDER BY closed_at DESC, order_id DESC) AS i FROM trades) WHERE i <= 50),
(SELECT avg(severity_score) AS avg_severity, count(*) AS f FROM (SELECT severity_score FROM fails ORDER BY created_at DESC, order_id DESC LIMIT 5)))""")
def _(spark, d):
    return A.circuit_state(T(spark, d), failures(spark, d))


@query("A32_circuit_boards", "board label losses! percent#2", """
SELECT board, label, count(*) AS losses, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY board), 2) AS percent FROM (
SELECT board, label FROM (SELECT 'session' AS board, session AS label FROM newest20 UNION ALL SELECT 'hour', printf('%02d:00', extract(hour FROM closed_at)) FROM newest20)) GROUP BY 1, 2""",
       newest20="SELECT * FROM (SELECT * FROM tt ORDER BY closed_at DESC, order_id DESC LIMIT 20) WHERE realized_r <= 0")
def _(spark, d):
    return A.circuit_boards(TH(spark, d), "session")


@query("A33_symbol_throttle", "symbol trade_count! stop_hits! stop_rate_pct#4 consecutive_stop_hits! throttled? cooldown_until@ avg_fee_r#", """
SELECT *, CASE WHEN throttled THEN l + INTERVAL '240 minutes' END AS cooldown_until FROM (SELECT *, consecutive_stop_hits >= 3 OR stop_rate_pct >= 70 AS throttled FROM (
SELECT symbol, count(*) AS trade_count, count(CASE WHEN close_reason = 'HIT_SL' THEN 1 END) AS stop_hits, avg(CASE WHEN close_reason = 'HIT_SL' THEN 100.0 ELSE 0 END) AS stop_rate_pct, coalesce(min(CASE WHEN close_reason <> 'HIT_SL' THEN i END), count(*) + 1) - 1 AS consecutive_stop_hits, max(CASE WHEN close_reason = 'HIT_SL' THEN closed_at END) AS l, avg(fee_r) AS avg_fee_r
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY closed_at DESC, order_id DESC) AS i FROM trades) WHERE i <= 12 GROUP BY symbol))""")
def _(spark, d):
    return A.symbol_throttle(T(spark, d))


query("W58_consecutive_losses", "symbol consecutive_stop_hits!", """
SELECT symbol, coalesce(min(CASE WHEN close_reason <> 'HIT_SL' THEN i END), count(*) + 1) - 1 AS consecutive_stop_hits FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY closed_at DESC, order_id DESC) AS i FROM trades) WHERE i <= 30 GROUP BY symbol""")(
    lambda spark, d: A.symbol_throttle(T(spark, d), 30))


@query("A34_baseline_excess", "order_id vol_bucket baseline_mean# excess_r# excess_bucket", """
SELECT order_id, vol_bucket, baseline_mean, realized_r - baseline_mean AS excess_r, CASE WHEN realized_r - baseline_mean <= -0.3 THEN 'far_below_baseline' WHEN realized_r - baseline_mean <= -0.05 THEN 'below_baseline' WHEN realized_r - baseline_mean <= 0.05 THEN 'at_baseline' WHEN realized_r - baseline_mean <= 0.3 THEN 'above_baseline' ELSE 'far_above_baseline' END AS excess_bucket FROM (
SELECT *, CASE WHEN count(*) OVER w >= 10 THEN avg(realized_r) OVER w ELSE avg(realized_r) OVER () END AS baseline_mean FROM (
SELECT *, CASE WHEN notional_k <= q1 THEN 'low' WHEN notional_k <= q2 THEN 'mid_low' WHEN notional_k <= q3 THEN 'mid_high' ELSE 'high' END AS vol_bucket FROM trades, (SELECT quantile_cont(notional_k, 0.25) AS q1, quantile_cont(notional_k, 0.5) AS q2, quantile_cont(notional_k, 0.75) AS q3 FROM trades))
WINDOW w AS (PARTITION BY mode, direction, vol_bucket))""")
def _(spark, d):
    return A.baseline_excess(A.quartile_bucket(T(spark, d).select("order_id", "mode", "direction", "notional_k", "realized_r"), "notional_k", "vol_bucket"), ["mode", "direction", "vol_bucket"], "realized_r")


@query("A35_baselines", "baseline net_expectancy# net_sharpe# active_trades! exposure_pct#4", """
SELECT baseline, coalesce(avg(net), 0) AS net_expectancy, coalesce(avg(net) / nullif(stddev_samp(net), 0), 0) AS net_sharpe, count(net) AS active_trades, count(net) * 100.0 / count(*) AS exposure_pct FROM (
SELECT baseline, CASE WHEN pred = 'NO_TRADE' THEN NULL WHEN truth = 'NO_TRADE' THEN -0.1 WHEN pred = truth THEN realized_r - 0.1 ELSE -realized_r - 0.1 END AS net FROM (
SELECT truth, realized_r, 'ALWAYS_LONG' AS baseline, 'LONG_NOW' AS pred FROM acts UNION ALL SELECT truth, realized_r, 'ALWAYS_SHORT', 'SHORT_NOW' FROM acts UNION ALL SELECT truth, realized_r, 'NO_TRADE', 'NO_TRADE' FROM acts
UNION ALL SELECT truth, realized_r, 'RANDOM_ACTION', CASE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 3 WHEN 0 THEN 'LONG_NOW' WHEN 1 THEN 'SHORT_NOW' ELSE 'NO_TRADE' END FROM acts)) GROUP BY 1""")
def _(spark, d):
    return A.baselines(actions(spark, d), "truth", "realized_r", 0.05, ["doc_id"])


@query("A36_shadow_agreement", "compared! match_rate# mean_r_difference# degradation_rate#", """
SELECT count(*) AS compared, avg(CASE WHEN action = a2 THEN 1.0 ELSE 0 END) AS match_rate, avg(r2 - realized_r) AS mean_r_difference, avg(CASE WHEN action <> a2 AND r2 < realized_r THEN 1.0 ELSE 0 END) AS degradation_rate
FROM (SELECT *, CASE WHEN p >= 0.5 THEN 'LONG_NOW' ELSE 'SHORT_NOW' END AS a2, realized_r * CASE WHEN fold = 2 THEN 0.5 ELSE 1 END AS r2 FROM acts)""")
def _(spark, d):
    a = actions(spark, d)
    sh = a.withColumns({"action": F.when(F.col("p") >= 0.5, "LONG_NOW").otherwise("SHORT_NOW"),
                        "realized_r": F.col("realized_r") * F.when(F.col("fold") == 2, 0.5).otherwise(1.0)})
    return A.shadow_agreement(a, sh, "doc_id", "action", "realized_r")


@query("A37_audit_analytics", "name winner? pass_rate# avg_score# n!", """
SELECT name, realized_r > 0 AS winner, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) AS pass_rate, avg(score) AS avg_score, count(*) AS n FROM (
SELECT realized_r, 'confidence' AS name, confidence >= 60 AS passed, confidence / 100 AS score FROM trades UNION ALL SELECT realized_r, 'fee', fee_r <= 0.05, fee_r FROM trades) GROUP BY 1, 2""")
def _(spark, d):
    def k(name, ok, score):
        return F.struct(F.lit(name).alias("name"), ok.alias("passed"), score.alias("score"))
    t = T(spark, d).withColumn("checks", F.array(k("confidence", F.col("confidence") >= 60, F.col("confidence") / 100), k("fee", F.col("fee_r") <= 0.05, F.col("fee_r"))))
    return A.audit_analytics(t, "checks")


@query("A38_recommendations", "action dim label value#", """
SELECT 'scale_up' AS action, dim, label, avg_realized_r AS value FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY expectancy_score DESC, label) AS k FROM gm WHERE NOT provisional) WHERE k <= 2 AND avg_realized_r > 0
UNION ALL SELECT 'reduce_or_pause', dim, label, avg_realized_r FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY expectancy_score, label DESC) AS k FROM gm WHERE NOT provisional) WHERE k <= 2 AND avg_realized_r <= 0
UNION ALL SELECT 'tighten_confidence', 'confidence', bucket::VARCHAR, avg_realized_r FROM cb WHERE trades >= 10 AND avg_realized_r < 0""")
def _(spark, d):
    t = TH(spark, d)
    return A.recommendations(A.group_metrics(t, _GD), A.confidence_buckets(t), 10, 2)


@query("A39_learning_calibration", "bucket! sample_size! avg_predicted# win_rate# multiplier#", """
SELECT b AS bucket, n AS sample_size, ap AS avg_predicted, wr AS win_rate, least(1.05, greatest(0.55, least(1.05, greatest(0.55, wr / ap)) * w + gm * (1 - w))) AS multiplier FROM (
SELECT *, least(1.0, greatest(0.4, n / 6.0)) AS w, (SELECT least(1.05, greatest(0.55, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) / (avg(confidence) / 100))) FROM trades) AS gm FROM (
SELECT least(90, floor(confidence / 10) * 10)::INT AS b, count(*) AS n, avg(confidence) / 100 AS ap, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) AS wr FROM trades GROUP BY 1))""")
def _(spark, d):
    return A.learning_calibration(T(spark, d))


@query("A39_component_penalties", "blamed_component count! avg_severity# avg_confidence# top_source frequency# penalty#", """
SELECT blamed_component, n AS count, sv AS avg_severity, cf AS avg_confidence, top_source, f AS frequency, least(0.35, greatest(0, p2)) AS penalty FROM (SELECT *, CASE WHEN blamed_component = 'Stop Loss' AND top_source = 'RISK_MODEL' AND f >= 0.5 THEN greatest(p1, 0.2) ELSE p1 END AS p2 FROM (
SELECT *, CASE WHEN f >= 0.55 AND n >= 4 AND cf >= 0.7 THEN greatest(f * sv / 5 * greatest(cf, 0.5), 0.16) ELSE f * sv / 5 * greatest(cf, 0.5) END AS p1 FROM (
SELECT blamed_component, count(*) AS n, avg(severity_score) AS sv, avg(confidence) AS cf, count(*) / (SELECT count(*) FROM fails) AS f FROM fails GROUP BY 1)
JOIN (SELECT blamed_component, arg_max(failure_source, (n, failure_source)) AS top_source FROM (SELECT blamed_component, failure_source, count(*) AS n FROM fails GROUP BY 1, 2) GROUP BY 1) USING (blamed_component)))""")
def _(spark, d):
    return A.component_penalties(failures(spark, d))


@query("A39_entry_and_stop_rules", "timing_rate# stop_rate# entry_penalty# entry_active? stop_multiplier# stop_active? dominant_cluster# reject_active? reject_if_entry_risk_gte# reject_if_confidence_lte#", """
SELECT tr AS timing_rate, sr AS stop_rate, CASE WHEN tn = 0 THEN 0 ELSE least(0.35, greatest(e, CASE WHEN tr >= 0.55 AND tn >= 4 AND tc >= 0.7 THEN 0.15 ELSE 0 END, CASE WHEN tr >= 0.7 AND ts >= 4 THEN 0.22 ELSE 0 END)) END AS entry_penalty, on_ AND tn >= 2 AS entry_active,
 CASE WHEN sn = 0 THEN 1 ELSE 1 + least(0.55, sr * ss / 5 * greatest(sc, 0.5) * 0.8) END AS stop_multiplier, on_ AND sn >= 3 AS stop_active, dc AS dominant_cluster, on_ AND dc >= 0.55 AS reject_active, 0.72::DOUBLE AS reject_if_entry_risk_gte, 68.0::DOUBLE AS reject_if_confidence_lte
FROM (SELECT *, 0.35 * least(1, tr * ts / 5 * greatest(tc, 0.5)) AS e, n >= 5 AND (SELECT count(*) FROM trades) >= 20 AS on_, (SELECT max(k) / sum(k) FROM (SELECT count(*)::DOUBLE AS k FROM fails GROUP BY failure_source, blamed_component)) AS dc FROM (
SELECT count(*) AS n, avg(CASE WHEN t THEN 1.0 ELSE 0 END) AS tr, avg(v) FILTER (WHERE t) AS ts, avg(confidence) FILTER (WHERE t) AS tc, count(*) FILTER (WHERE t) AS tn, avg(CASE WHEN s THEN 1.0 ELSE 0 END) AS sr, avg(v) FILTER (WHERE s) AS ss, avg(confidence) FILTER (WHERE s) AS sc, count(*) FILTER (WHERE s) AS sn
FROM (SELECT *, CASE WHEN severity_score = 0 THEN 1 ELSE severity_score END AS v, failure_source = 'TIMING' OR blamed_component = 'Entry Logic' AS t, failure_source = 'RISK_MODEL' OR blamed_component = 'Stop Loss' OR classification = 'STOP_LOSS_HIT' AS s FROM fails)))""")
def _(spark, d):
    return A.entry_and_stop_rules(failures(spark, d), T(spark, d))


@query("A39_regime_stability", "total! unique_regimes! dominant_regime dominant_share# label damping#2", """
SELECT t AS total, u AS unique_regimes, dr AS dominant_regime, m / t AS dominant_share, CASE WHEN u >= 3 AND m / t < 0.45 THEN 'UNSTABLE' WHEN u >= 2 AND m / t < 0.6 THEN 'MIXED' ELSE 'STABLE' END AS label, CASE WHEN u >= 3 AND m / t < 0.45 THEN 0.72 WHEN u >= 2 AND m / t < 0.6 THEN 0.85 ELSE 1.0 END AS damping
FROM (SELECT sum(n) AS t, max(n) AS m, count(*) AS u, arg_max(regime, (n, regime)) AS dr FROM (SELECT regime, count(*) AS n FROM trades GROUP BY 1))""")
def _(spark, d):
    return A.regime_stability(T(spark, d))


@query("A40_learning_effectiveness", "adjustment trades_with! trades_without! avg_r_with# avg_r_without# win_rate_with# win_rate_without# severity_with# severity_without#", """
SELECT a AS adjustment, count(*) FILTER (WHERE has_a) AS trades_with, count(*) FILTER (WHERE NOT has_a) AS trades_without, avg(realized_r) FILTER (WHERE has_a) AS avg_r_with, avg(realized_r) FILTER (WHERE NOT has_a) AS avg_r_without, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE has_a) AS win_rate_with, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE NOT has_a) AS win_rate_without,
 avg(greatest(-realized_r, 0)) FILTER (WHERE has_a) AS severity_with, avg(greatest(-realized_r, 0)) FILTER (WHERE NOT has_a) AS severity_without FROM (SELECT t.*, c.a, list_contains(t.components, c.a) AS has_a FROM tt t, (SELECT DISTINCT component AS a FROM tc) c) GROUP BY 1""")
def _(spark, d):
    t = TH(spark, d).withColumn("sev", F.greatest(-F.col("realized_r"), F.lit(0.0)))
    return A.learning_effectiveness(t, "components", "sev")


@query("A41_calibration_readiness", "bucket! labelled! win_rate# ready?", "SELECT (floor(confidence / 20) * 20)::INT AS bucket, count(*) AS labelled, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) AS win_rate, count(*) >= 500 AS ready FROM trades GROUP BY 1")
def _(spark, d):
    return A.calibration_readiness(T(spark, d))


cte("trc", "SELECT *, CASE WHEN confidence < 30 THEN 'low_confidence' WHEN fee_r > 0.07 THEN 'fee_too_high' WHEN close_reason = 'EARLY_STALE_EXIT' THEN 'stale' END AS reason FROM trades")


def traces(spark, d):
    return T(spark, d).withColumn("reason", F.when(F.col("confidence") < 30, "low_confidence").when(F.col("fee_r") > 0.07, "fee_too_high")
                                  .when(F.col("close_reason") == "EARLY_STALE_EXIT", "stale"))


_DD = "count(*) AS decisions, count(reason) AS filtered, count(CASE WHEN reason IS NOT NULL AND direction = 'LONG' THEN 1 END) AS buy_filtered, count(CASE WHEN reason IS NOT NULL AND direction = 'SHORT' THEN 1 END) AS sell_filtered, avg(confidence) AS avg_confidence"


@query("A42_decision_diagnostics", "dim label decisions! filtered! buy_filtered! sell_filtered! avg_confidence#4", f"SELECT 'ALL' AS dim, 'ALL' AS label, {_DD} FROM trc UNION ALL SELECT 'symbol', symbol, {_DD} FROM trc GROUP BY symbol UNION ALL SELECT 'mode', mode, {_DD} FROM trc GROUP BY mode")
def _(spark, d):
    return A.decision_diagnostics(traces(spark, d), "reason", ["symbol", "mode"])


@query("A42_top_blockers", "reason count! symbols! modes! percentage#4", "SELECT reason, count(*) AS count, count(DISTINCT symbol) AS symbols, count(DISTINCT mode) AS modes, count(*) * 100.0 / (SELECT count(*) FROM trc) AS percentage FROM trc WHERE reason IS NOT NULL GROUP BY 1 ORDER BY 2 DESC LIMIT 10")
def _(spark, d):
    return A.top_blockers(traces(spark, d), "reason")


@query("A43_runtime_rates", "mode n! timeout_rate# rejection_rate# alerts", """
SELECT *, array_to_string(list_filter([CASE WHEN timeout_rate > 0.2 THEN 'timeout' END, CASE WHEN rejection_rate > 0.6 THEN 'rejection' END], lambda x: x IS NOT NULL), ',') AS alerts FROM (SELECT mode, count(*) AS n, avg(CASE WHEN close_reason = 'TIME_STOP' THEN 1.0 ELSE 0 END) AS timeout_rate, avg(CASE WHEN reason IS NOT NULL THEN 1.0 ELSE 0 END) AS rejection_rate FROM trc GROUP BY 1)""")
def _(spark, d):
    return A.runtime_rates(traces(spark, d), {"timeout": F.col("close_reason") == "TIME_STOP", "rejection": F.col("reason").isNotNull()}, {"timeout": 0.2, "rejection": 0.6}, ["mode"])


@query("A44_attribution_integrity", "mode trades! attributed! coverage#", """
SELECT t.mode, count(*) AS trades, count(a.order_id) AS attributed, count(a.order_id) / count(*) AS coverage FROM trades t LEFT JOIN (SELECT DISTINCT order_id FROM tc WHERE component = 'high_fee') a USING (order_id) GROUP BY 1""")
def _(spark, d):
    t = TH(spark, d)
    return A.attribution_integrity(t, t.filter(F.array_contains("components", "high_fee")), "order_id", "mode")


@query("A45_before_after_checks", "label avg_realized_r# limit#2 passed?", "SELECT label, avg_realized_r, CASE label WHEN 'SWING' THEN 0.05 ELSE 0.2 END AS \"limit\", avg_realized_r > CASE label WHEN 'SWING' THEN 0.05 ELSE 0.2 END AS passed FROM gm WHERE dim = 'mode' AND label IN ('SWING', 'SCALP')")
def _(spark, d):
    g = T(spark, d).groupBy(F.col("mode").alias("label")).agg(F.avg("realized_r").alias("avg_realized_r"))
    return A.before_after_checks(g, "label", "avg_realized_r", {"SWING": 0.05, "SCALP": 0.2})


@query("A46_market_overview", "symbol bar_ts@ close#2 signal_ts@ signal", """
SELECT b.*, s.signal_ts, s.signal FROM (SELECT symbol, max(ts) AS bar_ts, arg_max(close, ts) AS close FROM bars_1h GROUP BY 1) b LEFT JOIN (SELECT symbol, max(ts) AS signal_ts, arg_max(CASE WHEN close > open THEN 'BUY' ELSE 'SELL' END, ts) AS signal FROM bars_4h WHERE abs(close - open) > 20 GROUP BY 1) s USING (symbol)""")
def _(spark, d):
    sig = S.bars(spark, d).filter("abs(close - open) > 20").withColumn("signal", F.when(F.col("close") > F.col("open"), "BUY").otherwise("SELL"))
    return A.market_overview(S.bars(spark, d, "1 hour"), sig, ["symbol"])


@query("A47_manifest_diff", "run! name before#4 after#4", """
SELECT coalesce(a.run, b.run) AS run, coalesce(a.name, b.name) AS name, b.value AS before, a.value AS after FROM (SELECT * FROM mani WHERE run > (SELECT min(run) FROM mani)) a FULL JOIN (SELECT run + 1 AS run, name, value FROM mani WHERE run < (SELECT max(run) FROM mani)) b ON a.run = b.run AND a.name = b.name WHERE a.value IS DISTINCT FROM b.value""",
       mani="SELECT fold AS run, 'mean_p' AS name, round(avg(p), 2) AS value FROM preds GROUP BY 1 UNION ALL SELECT fold, 'positives', (count(CASE WHEN y = 1 THEN 1 END) > 10)::INT::DOUBLE FROM preds GROUP BY 1 UNION ALL SELECT fold, 'extra', 1.0 FROM preds WHERE fold % 2 = 0 GROUP BY 1")
def _(spark, d):
    g = S.predictions(spark, d).groupBy(F.col("fold").alias("run")).agg(
        F.round(F.avg("p"), 2).alias("mp"), (F.count(F.when(F.col("y") == 1, 1)) > 10).cast("double").alias("pos"))
    base = F.create_map(F.lit("mean_p"), F.col("mp"), F.lit("positives"), F.col("pos"))
    m = g.select("run", F.when(F.col("run") % 2 == 0, F.map_concat(base, F.create_map(F.lit("extra"), F.lit(1.0)))).otherwise(base).alias("params"))
    return A.manifest_diff(m, "run", "params")


@query("A48_candidate_vs_baseline", "mode avg_r_delta# win_rate_delta#4 verdict", """
SELECT mode, c.a - b.a AS avg_r_delta, c.w - b.w AS win_rate_delta, CASE WHEN c.a >= b.a AND c.w >= b.w THEN 'BETTER_OR_EQUAL' ELSE 'WORSE' END AS verdict FROM (SELECT mode, avg(realized_r) AS a, avg(CASE WHEN realized_r > 0 THEN 100.0 ELSE 0 END) AS w FROM trades WHERE confidence >= 60 GROUP BY 1) c JOIN (SELECT mode, avg(realized_r) AS a, avg(CASE WHEN realized_r > 0 THEN 100.0 ELSE 0 END) AS w FROM trades GROUP BY 1) b USING (mode)""")
def _(spark, d):
    t = T(spark, d)
    g = lambda x: x.groupBy("mode").agg(F.avg("realized_r").alias("avg_r"), (A.share(F.col("realized_r") > 0) * 100.0).alias("win_rate"))
    return A.candidate_vs_baseline(g(t.filter("confidence >= 60")), g(t), "mode", ["avg_r", "win_rate"])


@query("A49_filter_on_off", "variant trades! expectancy# profit_factor# sharpe# max_drawdown_r#3", """
SELECT variant, count(*) AS trades, avg(realized_r) AS expectancy, sum(greatest(realized_r, 0)) / abs(sum(least(realized_r, 0))) AS profit_factor, avg(realized_r) / stddev_samp(realized_r) AS sharpe, max(dd) AS max_drawdown_r FROM (
SELECT *, greatest(0, max(e) OVER (PARTITION BY variant ORDER BY closed_at, order_id ROWS UNBOUNDED PRECEDING)) - e AS dd FROM (SELECT *, sum(realized_r) OVER (PARTITION BY variant ORDER BY closed_at, order_id ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT *, 'off' AS variant FROM trades UNION ALL SELECT *, 'on' FROM trades WHERE confidence >= 50))) GROUP BY 1""")
def _(spark, d):
    return A.filter_on_off(T(spark, d), F.col("confidence") >= 50, "realized_r", 20)


# ---- ranking ---------------------------------------------------------------------

@query("K1_top_symbols_by_volume", "symbol qv#2", "SELECT symbol, sum(price * size) AS qv FROM ticks WHERE symbol <> 'S00' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    g = S.ticks(spark, d).filter("symbol <> 'S00'").groupBy("symbol").agg(F.sum(F.col("price") * F.col("size")).alias("qv"))
    return K.top_by(g, [F.desc("qv"), "symbol"], 5)


@query("K2_top_bottom_k", "mode side pos! order_id realized_r#4", """
SELECT mode, 'best' AS side, k AS pos, order_id, realized_r FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY realized_r DESC, order_id) AS k FROM trades) WHERE k <= 5
UNION ALL SELECT mode, 'worst', k, order_id, realized_r FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY realized_r, order_id) AS k FROM trades) WHERE k <= 5""")
def _(spark, d):
    return K.top_bottom_k(T(spark, d), ["mode"], "realized_r", "order_id", 5)


@query("K3_latest_per_key", "symbol pos! event_id! price#2", "SELECT * FROM (SELECT symbol, event_id, price, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS pos FROM ticks) WHERE pos <= 3")
def _(spark, d):
    return K.latest_per_key(S.ticks(spark, d), ["symbol"], ["ts", "event_id"], 3)


@query("K4_paged_list", "order_id closed_at@ realized_r#4", "SELECT order_id, closed_at, realized_r FROM trades WHERE mode = 'SCALP' ORDER BY closed_at DESC, order_id LIMIT 25 OFFSET 50")
def _(spark, d):
    return K.page(T(spark, d), F.col("mode") == "SCALP", [F.desc("closed_at"), "order_id"], 25, 50)


@query("K5_rank_candidates", "symbol rank! order_id", "SELECT * FROM (SELECT symbol, order_id, row_number() OVER (PARTITION BY symbol ORDER BY confidence DESC, fee_r, order_id) AS rank FROM trades) WHERE rank <= 10")
def _(spark, d):
    return K.rank_candidates(T(spark, d), ["symbol"], [F.desc("confidence"), "fee_r", "order_id"], 10)


@query("K6_cap_by_cumulative", "symbol rank! order_id cum_exposure#2 cluster_pos!", """
SELECT * FROM (SELECT *, sum(notional_k) OVER (PARTITION BY symbol ORDER BY rank) AS cum_exposure, row_number() OVER (PARTITION BY symbol, mode ORDER BY rank) AS cluster_pos FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confidence DESC, order_id) AS rank FROM trades) WHERE rank <= 8) WHERE cum_exposure <= 400 AND cluster_pos <= 3""")
def _(spark, d):
    return K.cap_by_cumulative(T(spark, d), ["symbol"], [F.desc("confidence"), "order_id"], "notional_k", 8, 400, "mode", 3)


@query("K7_stratified_sample", "mode direction order_id", "SELECT mode, direction, order_id FROM (SELECT *, row_number() OVER (PARTITION BY mode, direction ORDER BY md5(concat('42|', order_id)), order_id) AS k FROM trades) WHERE k <= 20")
def _(spark, d):
    return K.stratified_sample(T(spark, d), ["mode", "direction"], "order_id", 20)


# ---- sets and scalar helpers -----------------------------------------------------------

@query("U1_union", "symbol ts@ close#2", "SELECT symbol, ts, close FROM bars_4h UNION ALL SELECT symbol, ts, close FROM bars_1h")
def _(spark, d):
    return S.bars(spark, d).unionByName(S.bars(spark, d, "1 hour"))


@query("U2_intersect", "symbol ts@", "SELECT symbol, ts FROM bars_1h INTERSECT SELECT symbol, ts FROM funding")
def _(spark, d):
    return S.bars(spark, d, "1 hour").select("symbol", "ts").intersect(S.funding(spark, d).select("symbol", "ts"))


@query("U3_except", "symbol ts@", "SELECT symbol, ts FROM bars_4h EXCEPT SELECT symbol, ts FROM bars_1h")
def _(spark, d):
    return S.bars(spark, d).select("symbol", "ts").subtract(S.bars(spark, d, "1 hour").select("symbol", "ts"))


@query("U4_distinct_keep_last", "symbol ts@ event_id! price#2", "SELECT symbol, ts, max(event_id) AS event_id, arg_max(price, event_id) AS price FROM coarse GROUP BY 1, 2")
def _(spark, d):
    t = S.ticks(spark, d).withColumn("ts", S.bucket("ts", "10 minutes"))
    return Q.dedup_last(t, ["symbol", "ts"], ["event_id"])


@query("G1_json", "event_id! k! kv missing", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS kv, json_extract_string(props, '$.none') AS missing FROM events")
def _(spark, d):
    e = S.load(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.get_json_object("props", "$.k").alias("kv"),
                    F.variant_get(F.parse_json("props"), "$.none", "string").alias("missing"))


@query("G2_strings", "c_custkey! up parts! first key tail?", """
SELECT c_custkey, upper(trim(c_name)) AS up, len(string_split(c_name, '#')) AS parts, lower(string_split(c_name, '#')[1]) AS first, concat_ws('_', c_mktsegment, c_nationkey) AS key, regexp_matches(c_name, '7$') AS tail FROM customer""")
def _(spark, d):
    cst = S.load(spark, d, "customer")
    sp = F.split("c_name", "#")
    return cst.select("c_custkey", F.upper(F.trim("c_name")).alias("up"), F.size(sp).alias("parts"), F.lower(F.get(sp, F.lit(0))).alias("first"),
                      F.concat_ws("_", "c_mktsegment", "c_nationkey").alias("key"), F.col("c_name").rlike("7$").alias("tail"))


@query("G3_dates", "event_id! b@ hour! dow! name minutes! recent?", """
SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS b, hour(ts) AS hour, isodow(ts) - 1 AS dow, strftime(ts, '%a') AS name, date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) AS minutes, ts >= TIMESTAMP '2024-01-20' AS recent FROM events""")
def _(spark, d):
    e = S.load(spark, d, "events")
    return e.select("event_id", S.bucket("ts", "15 minutes").alias("b"), F.hour("ts").alias("hour"), F.weekday("ts").alias("dow"), F.date_format("ts", "E").alias("name"),
                    F.timestamp_diff("MINUTE", F.lit("2024-01-01").cast("timestamp"), F.date_trunc("minute", "ts")).alias("minutes"),
                    (F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).alias("recent"))


@query("G4_math", "order_id clipped#4 sgn#2 lg# at# half_even#1 half_up#1", """
SELECT order_id, greatest(-0.3, least(0.3, realized_r)) AS clipped, sign(realized_r) AS sgn, ln(1 + notional_k) AS lg, atan(realized_r) AS at, round_even(confidence / 4, 0) AS half_even, round(confidence / 4) AS half_up FROM trades""")
def _(spark, d):
    from barlens.functions.core import clip
    return T(spark, d).select("order_id", clip("realized_r", -0.3, 0.3).alias("clipped"), F.signum("realized_r").alias("sgn"), F.log(1 + F.col("notional_k")).alias("lg"),
                              F.atan("realized_r").alias("at"), F.bround(F.col("confidence") / 4, 0).alias("half_even"), F.round(F.col("confidence") / 4, 0).alias("half_up"))


@query("G5_arrays", "vec_id! n! top! hi#4 shared! merged", """
SELECT vec_id, len(embedding) AS n, list_position(embedding, list_max(embedding)) - 1 AS top, list_sum(list_sort(embedding, 'DESC')[1:3]::DOUBLE[]) AS hi, len(list_intersect([label, 1, 2], [1, 2, 3])) AS shared, concat_ws(',', CASE WHEN label % 2 = 0 THEN 'a=1' ELSE 'a=2' END, 'b=3') AS merged FROM embeddings""")
def _(spark, d):
    e = S.load(spark, d, "embeddings")
    v = F.col("embedding")
    hi = F.aggregate(F.slice(F.sort_array(v, False), 1, 3), F.lit(0.0), lambda a, x: a + x.cast("double"))
    m = F.map_concat(F.create_map(F.lit("b"), F.lit(3)), F.create_map(F.lit("a"), F.when(F.col("label") % 2 == 0, 1).otherwise(2)))
    return e.select("vec_id", F.size(v).alias("n"), (F.array_position(v, F.array_max(v)) - 1).alias("top"), hi.alias("hi"),
                    F.size(F.array_intersect(F.array(F.col("label"), F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("shared"),
                    F.concat_ws(",", F.concat(F.lit("a="), m["a"].cast("string")), F.concat(F.lit("b="), m["b"].cast("string"))).alias("merged"))
