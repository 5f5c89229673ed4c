"""Queries: labels (L1..L7, L13..L17), splits (L8..L12), portfolios (L18..L20, W57)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions import trading as P
from barlens.functions.core import div
from barlens.operators import features as ft, labels as LB, portfolio as PF, splits as SP, timegrid as T
from barlens.operators.windows import lag, lead
from barlens.plans.ordered import blocked, core_rows, frame
from barlens.queries.features_q import win
from barlens.queries.joins_q import bar_labels
from barlens.queries.registry import cte, query
from barlens.sources import tables as S

H = 12


def blocked_bars(spark, d, lookback=16, lookahead=H + 1, freq="4 hours"):
    return ft.base(blocked(S.bars(spark, d, freq), lookback, lookahead))


def lb_sql(h, stop, target, need, atr=f"avg(tr) OVER {win(15)}", src="r4"):
    """Entry rows with their ATR, first hits, last close and excursions by a range join."""
    return f"""
SELECT b.*, x.n, coalesce(x.ls, 9999) AS ls, coalesce(x.lt, 9999) AS lt, coalesce(x.ss, 9999) AS ss, coalesce(x.st, 9999) AS st, x.lc FROM (
  SELECT * FROM (SELECT symbol, ts, rn, close AS entry, high, low, {atr} AS atr, max(rn) OVER (PARTITION BY symbol) AS lastrn FROM {src}) WHERE rn + {need} <= lastrn) b
JOIN (SELECT e.symbol, e.rn, count(*) AS n, min(f.rn - e.rn) FILTER (WHERE f.low <= e.close - e.atr * {stop}) AS ls, min(f.rn - e.rn) FILTER (WHERE f.high >= e.close + e.atr * {target}) AS lt,
             min(f.rn - e.rn) FILTER (WHERE f.high >= e.close + e.atr * {stop}) AS ss, min(f.rn - e.rn) FILTER (WHERE f.low <= e.close - e.atr * {target}) AS st, arg_max(f.close, f.rn) AS lc
      FROM (SELECT *, {atr} AS atr FROM {src}) e JOIN {src} f ON f.symbol = e.symbol AND f.rn BETWEEN e.rn + 1 AND e.rn + {h} GROUP BY 1, 2) x USING (symbol, rn)"""


def side_sql(side, h, stop, target):
    s, t = ("ls", "lt") if side == "LONG" else ("ss", "st")
    sg = 1 if side == "LONG" else -1
    return f"""
SELECT symbol, ts, rn, entry, atr, CASE WHEN {s} <= {t} AND {s} < 9999 THEN 'STOP_HIT' WHEN {t} < 9999 THEN 'TARGET_HIT' ELSE 'TIME_EXIT' END AS exit_reason,
  CASE WHEN {s} <= {t} AND {s} < 9999 THEN {s} WHEN {t} < 9999 THEN {t} ELSE n END AS hold_bars,
  CASE WHEN {s} <= {t} AND {s} < 9999 THEN {s} - 1 WHEN {t} < 9999 THEN {t} - 1 ELSE n END AS seen,
  CASE WHEN {s} <= {t} AND {s} < 9999 THEN entry - {sg} * atr * {stop} WHEN {t} < 9999 THEN entry + {sg} * atr * {target} ELSE lc END AS exit_price,
  coalesce({sg} * (CASE WHEN {s} <= {t} AND {s} < 9999 THEN entry - {sg} * atr * {stop} WHEN {t} < 9999 THEN entry + {sg} * atr * {target} ELSE lc END - entry) / nullif(atr * {stop}, 0), 0) AS gross_r FROM lbx"""


def exc_sql(side):
    g, l = ("f.high - e.entry", "f.low - e.entry") if side == "LONG" else ("e.entry - f.low", "e.entry - f.high")
    return f"""
SELECT e.*, coalesce(max({g}), 0) AS mfe, least(coalesce(min({l}), 0), 0) AS mae, coalesce(arg_max(f.rn - e.rn - 1, ({g}, e.rn - f.rn)), 0) AS time_to_mfe
FROM lbs_{side.lower()} e LEFT JOIN r4 f ON f.symbol = e.symbol AND f.rn BETWEEN e.rn + 1 AND e.rn + e.seen GROUP BY ALL"""


cte("lbx", lb_sql(H, 1.5, 1.5, H + 1))
cte("lbs_long", side_sql("LONG", H, 1.5, 1.5))
cte("lbs_short", side_sql("SHORT", H, 1.5, 1.5))
cte("lbe_long", exc_sql("LONG"))
cte("lbe_short", exc_sql("SHORT"))
_XC = "exit_reason exit_price#2 hold_bars! gross_r# mfe# mae# mfe_r# mae_r# time_to_mfe!"


def _l1(side):
    def run(spark, d):
        return LB.barrier_label(blocked_bars(spark, d)).select("symbol", "ts", f"{side}.*")
    return run


for _s in ("long", "short"):
    query(f"L1_barrier_exit_{_s}", "symbol ts@ " + _XC, f"""
SELECT *, coalesce(mfe / nullif(atr * 1.5, 0), 0) AS mfe_r, coalesce(mae / nullif(atr * 1.5, 0), 0) AS mae_r FROM lbe_{_s}""")(_l1(_s))

cte("lb2", """
SELECT *, greatest(0, -least(long_net, short_net)) AS s, CASE WHEN greatest(long_net, short_net) > 0.15 THEN greatest(long_net, short_net) ELSE 0 END AS m FROM (
SELECT l.symbol, l.ts, l.rn, l.gross_r - cost AS long_net, h.gross_r - cost AS short_net, cost,
  l.gross_r - cost - 2 * abs(coalesce(l.mae / risk, 0)) - 2 * cost - 1.5 * l.time_to_mfe * 0.1 AS lu, h.gross_r - cost - 2 * abs(coalesce(h.mae / risk, 0)) - 2 * cost - 1.5 * h.time_to_mfe * 0.1 AS su
FROM (SELECT *, nullif(atr * 1.5, 0) AS risk, coalesce((entry * 0.0008 + 2 * entry * 0.0001 * (1 + atr / entry)) / nullif(atr * 1.5, 0), 0) AS cost FROM lbe_long) l JOIN lbe_short h USING (symbol, rn))""")
_RANK = "list_sort([{'n': -lu, 'i': 0, 'a': 'LONG_NOW'}, {'n': -su, 'i': 1, 'a': 'SHORT_NOW'}, {'n': -(s - 0.5 * m), 'i': 2, 'a': 'NO_TRADE'}])"


@query("L2_barrier_label", "symbol ts@ long_net# short_net# cost_r# saved_loss_r# missed_opportunity_r# best_action second_best_action action_gap_r#", f"""
SELECT symbol, ts, long_net, short_net, cost AS cost_r, s AS saved_loss_r, m AS missed_opportunity_r, CASE WHEN gap < 0.1 THEN 'NO_TRADE' ELSE r[1].a END AS best_action, r[2].a AS second_best_action,
  CASE WHEN gap < 0.1 THEN 0 ELSE gap END AS action_gap_r FROM (SELECT *, r[2].n - r[1].n AS gap FROM (SELECT *, {_RANK} AS r FROM lb2))""")
def _(spark, d):
    return LB.barrier_label(blocked_bars(spark, d))


cte("lb3x", lb_sql(24, 2.5, 2.5, 25).replace("FROM lbx", "FROM lb3x"))


@query("L3_r_multiple_label", "symbol ts@ long_r# short_r# label! net_r#", """
SELECT *, CASE label WHEN 0 THEN long_r WHEN 1 THEN short_r ELSE 0 END AS net_r FROM (
SELECT *, CASE WHEN NOT ok OR abs(long_r - short_r) <= 0.1 THEN 2 WHEN long_r > short_r AND long_r > 0.15 THEN 0 WHEN short_r > long_r AND short_r > 0.15 THEN 1 ELSE 2 END AS label FROM (
SELECT symbol, ts, ok, CASE WHEN ok THEN CASE WHEN ls <= lt AND ls < 9999 THEN -1 WHEN lt < 9999 THEN 1 ELSE (lc - entry) / (atr * 2.5) END - 0.0008 * entry / (atr * 2.5) ELSE 0 END AS long_r,
  CASE WHEN ok THEN CASE WHEN ss <= st AND ss < 9999 THEN -1 WHEN st < 9999 THEN 1 ELSE (entry - lc) / (atr * 2.5) END - 0.0008 * entry / (atr * 2.5) ELSE 0 END AS short_r
FROM (SELECT *, entry > 0 AND atr > 0 AND atr <= entry * 0.5 AS ok FROM lb3x)))""")
def _(spark, d):
    return LB.r_multiple_label(blocked_bars(spark, d, 16, 25))


@query("L4_forward_return_label", "symbol ts@ fwd# label! net_r# long_net# short_net#", """
SELECT symbol, ts, fwd, CASE WHEN fwd > 0.003 THEN 0 WHEN fwd < -0.003 THEN 1 ELSE 2 END AS label, CASE WHEN abs(fwd) > 0.003 THEN abs(fwd) - 0.001 ELSE 0 END AS net_r, greatest(fwd, 0) - 0.001 AS long_net, greatest(-fwd, 0) - 0.001 AS short_net
FROM (SELECT symbol, ts, rn, lead(close, 12) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd, max(rn) OVER (PARTITION BY symbol) AS l FROM b4) WHERE rn + 13 <= l""")
def _(spark, d):
    return LB.forward_return_label(blocked_bars(spark, d, 1))


_LEV = [1, 2, 3, 5, 7, 10]
cte("lb5x", lb_sql(H, 2.0, 2.0, H, atr="greatest(high - low, 10.0)"))


def _lev_rows():
    out = []
    for side, s, t, sg in (("LONG", "ls", "lt", 1), ("SHORT", "ss", "st", -1)):
        for lev in _LEV:
            liq = "9999" if lev == 1 else f"coalesce((SELECT min(f.rn - b.rn) FROM r4 f WHERE f.symbol = b.symbol AND f.rn BETWEEN b.rn + 1 AND b.rn + {H} AND {'f.low <=' if sg > 0 else 'f.high >='} b.entry * (1 - {sg} * (1.0 / {lev} - 0.004))), 9999)"
            out.append(f"SELECT b.*, '{side}' AS side, {lev} AS lev, {sg} AS sg, {s} AS s, {t} AS t, {liq} AS q FROM lb5x b")
    return " UNION ALL ".join(out)


@query("L5_leverage_label", "symbol ts@ direction! best_side best_leverage! margin_return# liquidation_rate#", """
SELECT symbol, ts, CASE WHEN go AND l1 > s1 THEN 0 WHEN go THEN 1 ELSE 2 END AS direction, CASE WHEN go THEN coalesce(best.side, 'NO_TRADE') ELSE 'NO_TRADE' END AS best_side,
  CASE WHEN go THEN coalesce(best.lev, 0) ELSE 0 END AS best_leverage, CASE WHEN go THEN coalesce(best.m, 0) ELSE 0 END AS margin_return, liquidation_rate FROM (
SELECT symbol, ts, max(net) FILTER (WHERE lev = 1 AND side = 'LONG') AS l1, max(net) FILTER (WHERE lev = 1 AND side = 'SHORT') AS s1, avg(CASE WHEN liq THEN 1.0 ELSE 0 END) AS liquidation_rate,
  greatest(max(net) FILTER (WHERE lev = 1 AND side = 'LONG'), max(net) FILTER (WHERE lev = 1 AND side = 'SHORT')) > 0.15 AND max(net) FILTER (WHERE lev = 1 AND side = 'LONG') <> max(net) FILTER (WHERE lev = 1 AND side = 'SHORT') AS go,
  arg_max({'side': side, 'lev': lev, 'm': m}, (m, sg, -lev)) FILTER (WHERE net > 0) AS best
FROM (SELECT *, CASE WHEN lev = 1 THEN net ELSE net * atr * 2 * lev / entry END AS m FROM (
  SELECT symbol, ts, side, lev, sg, entry, atr, q < 9999 AND q <= s AS liq,
    sg * (CASE WHEN q < 9999 AND q <= s THEN entry * (1 - sg * (1.0 / lev - 0.004)) WHEN s <= t AND s < 9999 THEN entry - sg * atr * 2 WHEN t < 9999 THEN entry + sg * atr * 2 ELSE lc END - entry) / (atr * 2)
    - (entry * 0.0008 + 2 * entry * 0.0001 * (1 + atr / entry)) / (atr * 2) AS net FROM levr)) GROUP BY symbol, ts)""", levr=_lev_rows())
def _(spark, d):
    return LB.leverage_label(blocked_bars(spark, d, 1))


@query("L6_candidate_outcomes", "row_id symbol ts@ side gross_r# net_r# cost_r# bars_held! exit_reason is_valid? profit_bucket is_strong_win? is_bad_state?", """
SELECT substr(sha256(concat_ws('_', symbol, epoch_ms(ts), side)), 1, 16) AS row_id, *, net_r <> 0 OR bars_held > 0 AS is_valid, CASE WHEN net_r <= -0.5 THEN 'big_loss' WHEN net_r <= -0.1 THEN 'loss' WHEN net_r <= 0 THEN 'breakeven' WHEN net_r <= 0.1 THEN 'small_win' WHEN net_r <= 0.5 THEN 'win' ELSE 'big_win' END AS profit_bucket,
  net_r > 0.5 AS is_strong_win, net_r < -0.5 AS is_bad_state FROM (
SELECT l.symbol, l.ts, 'LONG' AS side, l.gross_r, b.long_net AS net_r, b.cost AS cost_r, l.hold_bars AS bars_held, l.exit_reason FROM lbs_long l JOIN lb2 b USING (symbol, rn)
UNION ALL SELECT l.symbol, l.ts, 'SHORT', l.gross_r, b.short_net, b.cost, l.hold_bars, l.exit_reason FROM lbs_short l JOIN lb2 b USING (symbol, rn))""")
def _(spark, d):
    return LB.candidate_rows(LB.barrier_label(blocked_bars(spark, d)), ["symbol", "ts"])


@query("L7_noise_robustness", "symbol ts@ mean_r# std_r# p_stop# p_target# cvar_5# stability#")
def _(spark, d):
    return LB.noise_robustness(blocked_bars(spark, d), 20, 0.01)


@query("L13_exclude_rows", "label_validity n!", "SELECT label_validity, count(*) AS n FROM lab4 WHERE label_validity = 'VALID' GROUP BY 1")
def _(spark, d):
    return LB.exclude_rows(bar_labels(spark, d)).groupBy("label_validity").agg(F.count(F.lit(1)).alias("n"))


@query("L14_purge_violations", "symbol ts@ label_timestamp@", "SELECT symbol, ts, label_timestamp FROM lab4 WHERE ts >= label_timestamp")
def _(spark, d):
    return LB.purge_violations(bar_labels(spark, d), "ts", "label_timestamp")


_TH = [0.0, 0.25, 0.5, 0.75, 0.9]


@query("L15_meta_labels", "doc_id! meta! trust#", """
SELECT doc_id, CASE WHEN sign(p - 0.5) = sign(realized_r) AND abs(realized_r) >= 0.001 THEN 1 ELSE 0 END AS meta, p * (0.5 + 0.1 * fold) AS trust FROM preds""")
def _(spark, d):
    x = S.predictions(spark, d)
    return x.withColumns({"meta": LB.meta_label(F.col("p") - 0.5, "realized_r"), "trust": F.col("p") * (F.lit(0.5) + 0.1 * F.col("fold"))})


@query("L15_threshold_sweep", "threshold#2 trades! wins! win_rate# mean_r#", f"""
SELECT t AS threshold, count(*) AS trades, count(CASE WHEN realized_r > 0 THEN 1 END) AS wins, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(realized_r) AS mean_r
FROM preds, (SELECT unnest({_TH}::DOUBLE[]) AS t) WHERE p >= t GROUP BY t""")
def _(spark, d):
    from barlens.operators.trades import threshold_sweep
    return threshold_sweep(S.predictions(spark, d), "p", "realized_r", _TH)


@query("L16_kelly_stats", "fold! trades! winrate# avg_win# avg_loss# payoff_ratio# raw_kelly# half_leverage# quarter_leverage#", """
SELECT *, least(greatest(0, raw_kelly) * 0.5 * 5, 5) AS half_leverage, least(greatest(0, raw_kelly) * 0.25 * 5, 3) AS quarter_leverage FROM (
SELECT *, CASE WHEN avg_win = 0 THEN 0 WHEN avg_loss = 0 THEN 1 ELSE (winrate * payoff_ratio - (1 - winrate)) / payoff_ratio END AS raw_kelly FROM (
SELECT *, avg_win / nullif(avg_loss, 0) AS payoff_ratio FROM (
SELECT fold, count(*) AS trades, avg(CASE WHEN realized_r > 0 THEN 1.0 ELSE 0 END) AS winrate, coalesce(avg(realized_r) FILTER (WHERE realized_r > 0), 0) AS avg_win, coalesce(abs(avg(realized_r) FILTER (WHERE realized_r <= 0)), 0) AS avg_loss FROM preds GROUP BY fold)))""")
def _(spark, d):
    from barlens.operators.trades import kelly_stats
    return kelly_stats(S.predictions(spark, d), ["fold"], "realized_r")


@query("L17_lineage_checksum", "symbol ts@ checksum")
def _(spark, d):
    return bar_labels(spark, d).withColumn("checksum", LB.lineage_checksum("symbol", "ts", "label_validity", "label_timestamp", "up"))


# ---- splits ------------------------------------------------------------------

@query("L8_walk_forward_folds", "fold! role n! first_ts@ last_ts@", """
SELECT fold, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
SELECT o.ts, k.fold, CASE WHEN o.ts >= lo + to_days((365 + k.fold * 60)::INT) AND o.ts < lo + to_days((425 + k.fold * 60)::INT) THEN 'val' WHEN o.ts >= lo + to_days((k.fold * 60)::INT) AND o.ts < lo + to_days((365 + k.fold * 60)::INT) THEN 'train' END AS role
FROM bars_1d_orders o, (SELECT min(ts) AS lo, max(ts) AS hi FROM bars_1d_orders) r, (SELECT unnest(range(0, 100)) AS fold) k WHERE lo + to_days((425 + k.fold * 60)::INT) <= hi) WHERE role IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    x = SP.walk_forward_folds(S.bars_1d_orders(spark, d), 365, 60)
    return x.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _wf_sql(anchored):
    lo = "0" if anchored else "k * 60"
    return f"""
SELECT t.ts, t.ti, f.k AS fold, CASE WHEN ti >= {lo} AND ti < 60 + k * 60 THEN 'train' WHEN ti >= 70 + k * 60 AND ti < 70 + k * 60 + v THEN 'val' WHEN ti >= 80 + k * 60 + v AND ti < least(80 + k * 60 + v + o, 120 + k * 60) THEN 'oos' END AS role
FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS ti, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars_4h)) t, (SELECT unnest(range(0, 10)) AS k, 20 AS v, 20 AS o) f WHERE f.k < (n - 60 - 50) // 60 + 1"""


cte("wfa", f"SELECT * FROM ({_wf_sql(True)}) WHERE role IS NOT NULL")


@query("L9_walk_forward_split", "ts@ ti! fold! role", "SELECT * FROM wfa")
def _(spark, d):
    return SP.walk_forward_roles(S.bars(spark, d), 60, 50, 10)


query("L9_walk_forward_rolling", "ts@ ti! fold! role", f"SELECT * FROM ({_wf_sql(False)}) WHERE role IS NOT NULL")(
    lambda spark, d: SP.walk_forward_roles(S.bars(spark, d), 60, 50, 10, anchored=False))


@query("L10_purge_gap", "fold! purge_before_val! purge_before_oos! embargo_distance! ok?", """
SELECT *, purge_before_val >= 10 AND purge_before_oos >= 10 AS ok FROM (SELECT fold, min(ti) FILTER (WHERE role = 'val') - max(ti) FILTER (WHERE role = 'train') - 1 AS purge_before_val,
  min(ti) FILTER (WHERE role = 'oos') - max(ti) FILTER (WHERE role = 'val') - 1 AS purge_before_oos, min(ti) FILTER (WHERE role <> 'train') - max(ti) FILTER (WHERE role = 'train') - 1 AS embargo_distance FROM wfa GROUP BY fold)""")
def _(spark, d):
    return SP.purge_report(SP.walk_forward_roles(S.bars(spark, d), 60, 50, 10), 10)


cte("tsplit", """
SELECT *, CASE WHEN i < floor(n * 0.6) THEN 'discovery' WHEN i < floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'holdout' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY ts, symbol) - 1 AS i, count(*) OVER () AS n FROM bars_4h)""")


@query("L11_temporal_split", "symbol ts@ split", "SELECT symbol, ts, split FROM tsplit")
def _(spark, d):
    return SP.temporal_split(S.bars(spark, d), ["ts", "symbol"])


@query("L12_purged_expanding", "ts@ ti! fold! role", """
SELECT * FROM (SELECT ts, ti, k AS fold, CASE WHEN ti < (k + 1) * b - greatest(b // 4, 6) THEN 'train' WHEN ti >= (k + 1) * b + greatest(b // 8, 6) AND ti < least((k + 2) * b, n) THEN 'val' END AS role
FROM (SELECT *, n // 4 AS b FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS ti, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars_4h))), (SELECT unnest(range(0, 3)) AS k)) WHERE role IS NOT NULL""")
def _(spark, d):
    return SP.purged_expanding_roles(S.bars(spark, d), 3, 3)


# ---- portfolios -----------------------------------------------------------------

cte("xsp", """
SELECT symbol, ts, dense_rank() OVER (ORDER BY ts) - 1 AS ti, close, close / lag(close, 1) OVER w - 1 AS m1, close / lag(close, 4) OVER w - 1 AS m4, close / lag(close, 12) OVER w - 1 AS m12, close / lag(close, 24) OVER w - 1 AS m24,
  lead(close) OVER w / close - 1 AS nr FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
cte("xspos", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY rank) AS kk FROM (
SELECT *, CASE WHEN rank < greatest(1, floor(n * 0.2 + 1e-9)) THEN 1 WHEN rank >= n - greatest(1, floor(n * 0.2 + 1e-9)) THEN -1 END AS direction FROM (
SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) - 1 AS rank, count(*) OVER (PARTITION BY ts) AS n FROM (
SELECT *, m1 * (0.1::DOUBLE / 1) + m4 * 0.2 + m12 * 0.3 + m24 * 0.4 AS score FROM xsp) WHERE ti >= 24 AND (ti - 24) % 4 = 0 AND score IS NOT NULL)) WHERE direction IS NOT NULL AND abs(score) >= 2 * 0.00095 + 0.001) WHERE kk <= 8""")
cte("xsr", "SELECT ts, ti, avg(nr * direction) AS gross, count(*) AS n_positions, coalesce(avg(nr * direction), 0) - 0.00095 AS ret FROM xspos GROUP BY 1, 2")


def _xs_panel(spark, d):
    p = SP.with_time_index(T.align_union(S.bars(spark, d)), "ts")
    b = blocked(p, 24, 1)
    b = b.withColumns({f"mom_{n}": div("close", lag("close", n)) - 1.0 for n in PF.XS["windows"]})
    return core_rows(b.withColumn("next_ret", div(lead("close"), F.col("close")) - 1.0))


@query("L18_xs_momentum_portfolio", "ts@ ti! gross# n_positions! ret#", "SELECT * FROM xsr")
def _(spark, d):
    return PF.portfolio_returns(PF.momentum_positions(_xs_panel(spark, d)))


@query("L19_equal_weight_baseline", "ts@ ret#", "SELECT ts, avg(nr) AS ret FROM xsp GROUP BY ts HAVING avg(nr) IS NOT NULL")
def _(spark, d):
    return _xs_panel(spark, d).groupBy("ts").agg(F.avg("next_ret").alias("ret")).filter("ret is not null")


@query("L19_random_ranking", "ts@ ret# n_positions!", """
SELECT ts, coalesce(avg(nr * d), 0) - 0.00095 AS ret, count(*) AS n_positions FROM (
SELECT *, CASE WHEN rank < greatest(1, floor(n * 0.2 + 1e-9)) THEN 1 WHEN rank >= n - greatest(1, floor(n * 0.2 + 1e-9)) THEN -1 END AS d FROM (
SELECT *, row_number() OVER (PARTITION BY ts ORDER BY md5(concat_ws('|', '42', epoch(ts)::BIGINT, symbol)), symbol) - 1 AS rank, count(*) OVER (PARTITION BY ts) AS n FROM xsp
WHERE ti >= 24 AND (ti - 24) % 4 = 0 AND m1 + m4 + m12 + m24 IS NOT NULL)) WHERE d IS NOT NULL GROUP BY ts""")
def _(spark, d):
    return PF.portfolio_returns(PF.momentum_positions(_xs_panel(spark, d), random_seed=42))


@query("L20_return_metrics", "net_return# sharpe# profit_factor# max_drawdown#", """
SELECT arg_max(e, ts) - 1 AS net_return, avg(ret) / stddev_pop(ret) * sqrt(2190.0::DOUBLE) AS sharpe, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / abs(sum(CASE WHEN ret < 0 THEN ret ELSE 0 END)) AS profit_factor, min((e - greatest(pk, 1)) / greatest(pk, 1)) AS max_drawdown
FROM (SELECT *, max(e) OVER (ORDER BY ts) AS pk FROM (SELECT *, product(1 + ret) OVER (ORDER BY ts) AS e FROM (SELECT ts, ret * 0.01::DOUBLE AS ret FROM xsr)))""")
def _(spark, d):
    r = PF.portfolio_returns(PF.momentum_positions(_xs_panel(spark, d))).withColumn("ret", F.col("ret") * 0.01)
    return PF.return_metrics(r, [], ["ts"], "ret", 2190)


cte("eqm", """SELECT *, sum(realized_r) OVER (PARTITION BY mode ORDER BY closed_at, order_id ROWS UNBOUNDED PRECEDING) AS equity FROM trades""")


@query("W57_equity_curve", "order_id mode equity#4 peak#4 drawdown#4", """
SELECT order_id, mode, equity, greatest(0, max(equity) OVER w) AS peak, greatest(0, max(equity) OVER w) - equity AS drawdown FROM eqm WINDOW w AS (PARTITION BY mode ORDER BY closed_at, order_id ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return PF.equity_curve(S.trades(spark, d).select("order_id", "mode", "closed_at", "realized_r"), ["mode"], ["closed_at", "order_id"], "realized_r")


@query("W57_max_drawdown", "mode max_drawdown#4", """
SELECT mode, max(d) AS max_drawdown FROM (SELECT mode, greatest(0, max(equity) OVER (PARTITION BY mode ORDER BY closed_at, order_id ROWS UNBOUNDED PRECEDING)) - equity AS d FROM eqm) GROUP BY mode""")
def _(spark, d):
    return PF.max_drawdown(S.trades(spark, d), ["mode"], ["closed_at", "order_id"], "realized_r")
