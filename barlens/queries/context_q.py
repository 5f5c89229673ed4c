"""Queries: overlays, runtime indicators, stateful regimes (W41..W48, W52..W59, P15, P16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions import bars as B, trading as P
from barlens.functions.core import div
from barlens.operators import features as ft, indicators as IN, overlays as OV, regime as RG, timegrid as T
from barlens.queries.features_q import ALL, late_z_sql, roll, win
from barlens.queries.registry import cte, query
from barlens.sources import tables as S


def with_funding(spark, d, freq="1 hour"):
    f = T.ffill_resample(S.funding(spark, d), "1 hour")
    return T.reindex_overlay(S.bars(spark, d, freq), f, "rate", "funding_rate")


cte("bf1", "SELECT b.*, f.rate AS fr, CASE WHEN rn > 0 THEN volume * abs(close / lag(close) OVER (PARTITION BY b.symbol ORDER BY b.ts) - 1) END AS oiraw FROM b1 b LEFT JOIN funding_1h f ON f.symbol = b.symbol AND f.ts = b.ts")


def z_sql(x, n, fn="stddev_samp"):
    return f"CASE WHEN rn >= {n - 1} AND count({x}) OVER {win(n)} >= 2 AND {x} IS NOT NULL THEN CASE WHEN {fn}({x}) OVER {win(n)} < 1e-14 THEN 0 ELSE ({x} - avg({x}) OVER {win(n)}) / {fn}({x}) OVER {win(n)} END END"


@query("W41_funding_features", "symbol ts@ funding_rate_ma_N#9 funding_rate_vol_N#9 funding_rate_zscore_N#3 funding_rate_change_N#9", f"""
SELECT symbol, ts, {roll('avg({})', 'fr', 10)} AS "funding_rate_ma_N", {roll('stddev_samp({})', 'fr', 10)} AS "funding_rate_vol_N", {z_sql('fr', 10)} AS "funding_rate_zscore_N", fr - lag(fr) OVER (PARTITION BY symbol ORDER BY ts) AS "funding_rate_change_N" FROM bf1""")
def _(spark, d):
    return ft.on_bars(with_funding(spark, d), 24, OV.funding_group)


@query("W41_funding_proxy", "symbol ts@ funding_proxy#4", f"SELECT symbol, ts, -(close / avg(tp) OVER {ALL} - 1) * 100 AS funding_proxy FROM r4")
def _(spark, d):
    return ft.on_bars(S.bars(spark, d), 1, OV.funding_proxy)


@query("W42_oi_proxy", "symbol ts@ open_interest_proxy_N# funding_oi_divergence_N#3", f"""
SELECT symbol, ts, o AS "open_interest_proxy_N", {z_sql('fr', 10)} - {z_sql('o', 10)} AS "funding_oi_divergence_N" FROM (SELECT *, CASE WHEN rn >= 10 THEN {roll('avg({})', 'oiraw', 10)} END AS o FROM bf1)""")
def _(spark, d):
    return ft.on_bars(with_funding(spark, d), 24, OV.funding_group)


cte("bo1", "SELECT b.*, o.value AS oi FROM b1 b LEFT JOIN oi o ON o.symbol = b.symbol AND o.ts = b.ts")
_PAST = win(0, 10, "1 PRECEDING")


def pz(x):
    return f"CASE WHEN count({x}) OVER {_PAST} >= 3 THEN ({x} - avg({x}) OVER {_PAST}) / greatest(stddev_pop({x}) OVER {_PAST}, 1e-12) END"


@query("W43_open_interest", "symbol ts@ open_interest_change_N# open_interest_volume_ratio# open_interest_zscore_N# open_interest_change_pct_N#4", f"""
SELECT symbol, ts, oi - p AS open_interest_change_N, {roll('avg({})', 'oi', 10)} / nullif({roll('avg({})', 'volume', 10)}, 0) AS open_interest_volume_ratio, {z_sql('oi', 10)} AS open_interest_zscore_N, (oi / nullif(p, 0) - 1) * 100 AS open_interest_change_pct_N
FROM (SELECT *, lag(oi) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bo1)""".replace("AS open_interest_change_N", 'AS "open_interest_change_N"').replace("AS open_interest_zscore_N", 'AS "open_interest_zscore_N"').replace("AS open_interest_change_pct_N", 'AS "open_interest_change_pct_N"'))
def _(spark, d):
    b = T.reindex_overlay(S.bars(spark, d, "1 hour"), S.open_interest(spark, d), "value", "open_interest")
    return ft.on_bars(b, 12, OV.open_interest_group)


@query("W43_oi_price_divergence", "symbol ts@ divergence#", f"""
SELECT symbol, ts, CASE WHEN rn >= 10 AND oc_sd > 1e-6 THEN {pz('oc')} * {pz('rc')} END AS divergence FROM (SELECT *, stddev_pop(oc) OVER {_PAST} AS oc_sd FROM (SELECT *, (oi / nullif(lag(oi) OVER w, 0) - 1) * 100 AS oc, (close / lag(close) OVER w - 1) * 100 AS rc FROM bo1 WINDOW w AS (PARTITION BY symbol ORDER BY ts)))""")
def _(spark, d):
    b = T.reindex_overlay(S.bars(spark, d, "1 hour"), S.open_interest(spark, d), "value", "open_interest")
    from barlens.operators.windows import lag
    from barlens.plans.ordered import frame

    def group(x):
        x = OV.open_interest_group(x)
        x = x.withColumn("oc", (div("open_interest", lag("open_interest")) - 1.0) * 100.0)
        # windows without any movement are dominated by the 1e-12 floor; leave them out of the comparison
        return x.withColumn("divergence", F.when(F.stddev_pop("oc").over(frame(start=-10, end=-1)) > 1e-6, F.col("oi_price_divergence_N")))
    return ft.on_bars(b, 14, group)


@query("W44_basis", "symbol ts@ basis#4 basis_ma_N#4 basis_vol_N#4 basis_zscore_N# basis_regime_N#", f"""
SELECT symbol, ts, basis, {roll('avg({})', 'basis', 10)} AS "basis_ma_N", {roll('stddev_samp({})', 'basis', 10)} AS "basis_vol_N", {z_sql('basis', 10)} AS "basis_zscore_N", CASE WHEN basis > 2 THEN 1 WHEN basis < -2 THEN -1 WHEN basis IS NOT NULL THEN 0 END AS "basis_regime_N"
FROM (SELECT b.*, p.value / nullif(b.close, 0) * 10000 AS basis FROM b1 b LEFT JOIN premium p ON p.symbol = b.symbol AND p.ts = b.ts)""")
def _(spark, d):
    b = T.reindex_overlay(S.bars(spark, d, "1 hour"), S.premium_index(spark, d), "value", "premium")
    b = b.withColumn("basis", div("premium", "close") * 10000.0)
    return ft.on_bars(b, 10, OV.basis_group)


# ---- runtime indicators: one recursion for the exponential means, one for ADX -----------

cte("ri0", """
SELECT *, CASE WHEN rn > 0 THEN greatest(close - pc, 0) END AS g, CASE WHEN rn > 0 THEN greatest(pc - close, 0) END AS l, CASE WHEN rn > 0 AND high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
  CASE WHEN rn > 0 AND pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm, CASE WHEN rn > 0 THEN ln(close / pc) ELSE 0 END AS lr, coalesce(pc, close) AS pq FROM r4""")
_E = (9, 12, 13, 21, 26, 50, 200)
cte("ri_e", f"""
SELECT symbol, rn, {', '.join(f'close AS e{n}' for n in _E)}, 0.0::DOUBLE AS sg, NULL::DOUBLE AS gw, NULL::DOUBLE AS lw, tr AS trw, pdm AS pw, mdm AS mw FROM ri0 WHERE rn = 0
UNION ALL SELECT s.symbol, s.rn, {', '.join(f's.close * (2.0::DOUBLE / {n + 1}) + e.e{n} * (1 - 2.0::DOUBLE / {n + 1})' for n in _E)},
 0.2 * ((s.close * (2.0::DOUBLE / 13) + e.e12 * (1 - 2.0::DOUBLE / 13)) - (s.close * (2.0::DOUBLE / 27) + e.e26 * (1 - 2.0::DOUBLE / 27))) + 0.8 * e.sg,
 CASE WHEN e.gw IS NULL THEN s.g ELSE s.g / 14 + e.gw * 13 / 14 END, CASE WHEN e.lw IS NULL THEN s.l ELSE s.l / 14 + e.lw * 13 / 14 END, s.tr / 14 + e.trw * 13 / 14, s.pdm / 14 + e.pw * 13 / 14, s.mdm / 14 + e.mw * 13 / 14
FROM ri_e e JOIN ri0 s ON s.symbol = e.symbol AND s.rn = e.rn + 1""")
cte("ri1", """
SELECT s.*, e.e9, e.e12, e.e13, e.e21, e.e26, e.e50, e.e200, e.sg, e.pw, e.mw, CASE WHEN s.rn >= 14 THEN coalesce(100 - 100 / (1 + e.gw / nullif(e.lw, 0)), 50) ELSE 50 END AS rsi, CASE WHEN s.rn >= 13 THEN e.trw ELSE f.trw END AS atr
FROM ri0 s JOIN ri_e e USING (symbol, rn) LEFT JOIN (SELECT symbol, trw FROM ri_e WHERE rn = 13) f USING (symbol)""")
cte("ri2", "SELECT *, coalesce(abs(dmp - dmn) / nullif(dmp + dmn, 0) * 100, 0) AS dx FROM (SELECT *, coalesce(100 * pw / nullif(atr, 0), 0) AS dmp, coalesce(100 * mw / nullif(atr, 0), 0) AS dmn FROM ri1)")
cte("ri_x", "SELECT symbol, rn, dx AS adx FROM ri2 WHERE rn = 0 UNION ALL SELECT s.symbol, s.rn, s.dx / 14 + e.adx * 13 / 14 FROM ri_x e JOIN ri2 s ON s.symbol = e.symbol AND s.rn = e.rn + 1")


def pw(fn, x, n):
    return f"{fn}({x}) OVER {win(n)}"


def uo(n):
    return f"sum(close - least(low, pq)) OVER {win(n)} / nullif(sum(greatest(high, pq) - least(low, pq)) OVER {win(n)}, 0)"


cte("ri3", f"""
SELECT r.*, x.adx, coalesce((close - {pw('min', 'low', 14)}) / nullif({pw('max', 'high', 14)} - {pw('min', 'low', 14)}, 0) * 100, 50) AS stoch_k, coalesce((rsi - {pw('min', 'rsi', 14)}) / nullif({pw('max', 'rsi', 14)} - {pw('min', 'rsi', 14)}, 0) * 100, 50) AS srsi,
  {pw('avg', 'close', 20)} AS bbm, coalesce({pw('stddev_samp', 'close', 20)}, 0) AS bbs, coalesce(volume / nullif({pw('avg', 'volume', 20)}, 0), 1) AS vr,
  CASE WHEN r.rn >= 4 THEN coalesce({pw('stddev_samp', 'lr', 10)}, 0) ELSE 0 END AS rv10, CASE WHEN r.rn >= 5 THEN coalesce({pw('stddev_samp', 'lr', 20)}, 0) ELSE 0 END AS rv20, CASE WHEN r.rn >= 19 THEN {pw('stddev_samp', 'lr', 50)} ELSE 0 END AS rv50, CASE WHEN r.rn >= 4 THEN {pw('avg', 'lr', 20)} ELSE 0 END AS mr20,
  sum(tp * volume) OVER {ALL} / nullif(sum(volume) OVER {ALL}, 0) AS vw, sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER {ALL} AS obv, list(tp) OVER {win(20)} AS tpl
FROM ri2 r JOIN ri_x x ON x.symbol = r.symbol AND x.rn = r.rn""".replace("PARTITION BY symbol ORDER BY ts", "PARTITION BY r.symbol ORDER BY r.ts"))
_RIC = ("symbol ts@ ema_9# ema_21# ema_50# ema_200# rsi# rsi_slope# macd# macd_signal# macd_hist# stoch_k# stoch_d# stochrsi_k# bb_upper# bb_width#4 atr# atr_5bar_avg# adx# dmp# dmn# cci#4 ao# mom#2 willr# uo# bbp# vwap# obv#2 obv_slope#2 "
        "vol_ratio# vol_slope# price_vs_ema50#4 price_vs_vwap#4 log_return# realized_vol_20# return_skew_20# return_kurtosis_20# return_zscore# vol_cluster_ratio# return_trend_ratio# flow_imbalance# trade_intensity# avg_trade_notional#2")
_W = "(PARTITION BY symbol ORDER BY ts)"
cte("ri4", f"""
SELECT symbol, ts, rn, close, e9 AS ema_9, e21 AS ema_21, e50 AS ema_50, e200 AS ema_200, rsi, rsi - lag(rsi, 3) OVER {_W} AS rsi_slope, e12 - e26 AS macd, sg AS macd_signal, e12 - e26 - sg AS macd_hist, stoch_k, {pw('avg', 'stoch_k', 3)} AS stoch_d, {pw('avg', 'srsi', 3)} AS stochrsi_k,
  bbm + 2 * bbs AS bb_upper, coalesce(4 * bbs / nullif(bbm, 0) * 100, 0) AS bb_width, atr, {pw('avg', 'atr', 5)} AS atr_5bar_avg, CASE WHEN rn >= 13 THEN adx ELSE 0 END AS adx, dmp, dmn,
  coalesce((tp - list_avg(tpl)) / nullif(0.015 * list_avg(list_transform(tpl, lambda q: abs(q - list_avg(tpl)))), 0), 0) AS cci, {pw('avg', 'mid', 5)} - {pw('avg', 'mid', 34)} AS ao, coalesce(close - lag(close, 10) OVER {_W}, 0) AS mom,
  coalesce(-100 * ({pw('max', 'high', 14)} - close) / nullif({pw('max', 'high', 14)} - {pw('min', 'low', 14)}, 0), -50) AS willr, coalesce(100 * (4 * {uo(7)} + 2 * {uo(14)} + {uo(28)}) / 7, 50) AS uo, high + low - 2 * e13 AS bbp, coalesce(vw, close) AS vwap, obv, coalesce(obv - lag(obv, 5) OVER {_W}, 0) AS obv_slope,
  vr AS vol_ratio, CASE WHEN rn >= 1 THEN coalesce(regr_slope(vr, rn) OVER {win(5)}, 0) ELSE 0 END AS vol_slope, (close - e50) / nullif(e50, 0) * 100 AS price_vs_ema50, (close - vw) / nullif(vw, 0) * 100 AS price_vs_vwap, lr AS log_return, rv20 AS realized_vol_20,
  CASE WHEN rn >= 7 THEN skewness(lr) OVER {win(20)} ELSE 0 END AS return_skew_20, CASE WHEN rn >= 7 THEN kurtosis(lr) OVER {win(20)} ELSE 0 END AS return_kurtosis_20, coalesce(lr / nullif(rv20, 0), 0) AS return_zscore, coalesce(rv10 / nullif(rv50, 0), 1) AS vol_cluster_ratio, coalesce(mr20 / nullif(rv20, 0), 0) AS return_trend_ratio,
  coalesce((2 * taker_buy_volume - volume) / nullif(volume, 0), 0) AS flow_imbalance, CASE WHEN rn >= 2 THEN trade_count / ({pw('avg', 'trade_count', 20)}) ELSE 1 END AS trade_intensity, quote_volume / trade_count AS avg_trade_notional FROM ri3""")


@query("W46_runtime_indicators", _RIC, "SELECT * FROM ri4")
def _(spark, d):
    return IN.runtime_indicators(S.bars(spark, d))


@query("W54_context_snapshot", "symbol ts@ close#2 rsi# atr# vol_ratio# vol_cluster_ratio# session_label volatility_regime", """
SELECT *, CASE WHEN hour(ts) < 7 THEN 'ASIA' WHEN hour(ts) < 12 THEN 'LONDON' WHEN hour(ts) < 16 THEN 'LONDON_NEW_YORK_OVERLAP' WHEN hour(ts) < 21 THEN 'NEW_YORK' ELSE 'OFF_HOURS' END AS session_label, CASE WHEN vol_cluster_ratio >= 1.35 THEN 'EXPANDING' WHEN vol_cluster_ratio <= 0.75 THEN 'CONTRACTING' ELSE 'STABLE' END AS volatility_regime
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS kk FROM ri4) WHERE kk = 1""")
def _(spark, d):
    return IN.latest_snapshot(IN.runtime_indicators(S.bars(spark, d)), ["close", "rsi", "atr", "vol_ratio", "vol_cluster_ratio"])


# ---- multi-timeframe ----------------------------------------------------------------

cte("c0", """SELECT *, CASE WHEN rn = 0 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, ln(close / pc) AS ret, CASE WHEN rn > 0 THEN greatest(close - pc, 0) END AS g, CASE WHEN rn > 0 THEN greatest(pc - close, 0) END AS l
FROM (SELECT *, block AS rn, lag(close) OVER (PARTITION BY symbol ORDER BY block) AS pc FROM k4)""")
cte("c1", "SELECT *, avg(g) OVER w AS gm, avg(l) OVER w AS lm FROM c0 WINDOW w AS (PARTITION BY symbol ORDER BY block ROWS UNBOUNDED PRECEDING)")


def _k(n):
    return f"(2.0::DOUBLE / {n + 1})"


cte("c_e", f"""
SELECT symbol, rn, close AS e5, close AS e20, tr AS a, tr AS am, volume AS v, NULL::DOUBLE AS ag, NULL::DOUBLE AS al FROM c1 WHERE rn = 0
UNION ALL SELECT s.symbol, s.rn, s.close * {_k(5)} + e.e5 * (1 - {_k(5)}), s.close * {_k(20)} + e.e20 * (1 - {_k(20)}), s.tr * {_k(14)} + e.a * (1 - {_k(14)}), (s.tr * {_k(14)} + e.a * (1 - {_k(14)})) * {_k(50)} + e.am * (1 - {_k(50)}), s.volume * {_k(20)} + e.v * (1 - {_k(20)}),
  CASE WHEN s.rn < 14 THEN NULL WHEN s.rn = 14 THEN s.gm ELSE (e.ag * 13 + s.g) / 14 END, CASE WHEN s.rn < 14 THEN NULL WHEN s.rn = 14 THEN s.lm ELSE (e.al * 13 + s.l) / 14 END FROM c_e e JOIN c1 s ON s.symbol = e.symbol AND s.rn = e.rn + 1""")
cte("c2", f"""
SELECT s.symbol, s.rn AS block, s.rn, e.e5 - lag(e.e5) OVER (PARTITION BY s.symbol ORDER BY s.rn) AS ema_slope, (e.e5 - e.e20) / greatest(close, 1e-10) AS trend_strength, CASE WHEN sd * 4 > 1e-10 THEN (close - (e.e20 - 2 * sd)) / (4 * sd) END AS bb_position, 100 - 100 / (1 + e.ag / greatest(e.al, 1e-10)) AS rsi,
  CASE WHEN e.am > 1e-10 THEN e.a / e.am END AS atr_regime, CASE WHEN vl > 1e-10 THEN vs / vl END AS vol_expansion, CASE WHEN e.v > 1e-10 THEN volume / e.v END AS volume_ratio
FROM (SELECT *, CASE WHEN rn >= 19 THEN stddev_samp(close) OVER {win(20)} END AS sd, CASE WHEN count(ret) OVER {win(5)} >= 5 THEN stddev_samp(ret) OVER {win(5)} END AS vs, CASE WHEN count(ret) OVER {win(20)} >= 20 THEN stddev_samp(ret) OVER {win(20)} END AS vl FROM c1) s JOIN c_e e ON e.symbol = s.symbol AND e.rn = s.rn""")
_CX = "ema_slope trend_strength bb_position rsi atr_regime vol_expansion volume_ratio".split()


@query("W47_mtf_context", "symbol ts@ " + " ".join(f"{x}#4" for x in _CX), f"""
SELECT b.symbol, b.ts, {', '.join(_CX)} FROM (SELECT *, CASE WHEN rn = max(rn) OVER (PARTITION BY symbol) THEN rn // 4 ELSE (rn + 1) // 4 - 1 END AS kb FROM b1) b
LEFT JOIN (SELECT symbol, block, {', '.join(f'last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY block ROWS UNBOUNDED PRECEDING) AS {x}' for x in _CX)} FROM c2) k ON k.symbol = b.symbol AND k.block = b.kb""")
def _(spark, d):
    return OV.mtf_context(S.bars(spark, d, "1 hour"), 4)


@query("W48_local_context", "symbol ts@ local_range#4 local_volatility#4 local_momentum#4", """
SELECT b.symbol, b.ts, local_range, local_volatility, local_momentum FROM (SELECT *, (rn + 1) // 4 - 1 AS kb FROM b1) b
LEFT JOIN (SELECT k.symbol, k.block, k.high - k.low AS local_range, (k.high - k.low) / greatest(c.c0v, 1e-10) AS local_volatility, (k.close - c.c0v) / greatest(c.c0v, 1e-10) AS local_momentum FROM k4 k JOIN (SELECT symbol, rn // 4 AS block, arg_min(close, ts) AS c0v FROM b1 GROUP BY 1, 2) c USING (symbol, block) WHERE k.n_bars = 4) x ON x.symbol = b.symbol AND x.block = b.kb""")
def _(spark, d):
    return OV.local_context(S.bars(spark, d, "1 hour"), 4)


cte("fr_e", f"SELECT symbol, rn, abs(fr) AS m FROM bf1 WHERE rn = 0 UNION ALL SELECT s.symbol, s.rn, CASE WHEN e.m IS NULL THEN abs(s.fr) WHEN s.fr IS NULL THEN e.m ELSE abs(s.fr) * {_k(24)} + e.m * (1 - {_k(24)}) END FROM fr_e e JOIN bf1 s ON s.symbol = e.symbol AND s.rn = e.rn + 1")


def _fr_sql(mean):
    past = win(0, 48, "1 PRECEDING")
    return f"""
SELECT symbol, ts, CASE WHEN rn >= 48 AND sd > 1e-10 THEN (fr - av) / sd END AS funding_zscore, sign(fr) AS funding_direction, CASE WHEN t > 0 THEN CASE WHEN m > t * 1.5 THEN 2 WHEN m < t * 0.5 THEN 0 WHEN m IS NOT NULL THEN 1 END END AS funding_regime
FROM (SELECT b.*, e.m, stddev_pop(fr) OVER {past} AS sd, avg(fr) OVER {past} AS av, {mean} AS t FROM bf1 b JOIN fr_e e ON e.symbol = b.symbol AND e.rn = b.rn)""".replace("PARTITION BY symbol ORDER BY ts", "PARTITION BY b.symbol ORDER BY b.ts")


_FRC = "symbol ts@ funding_zscore#3 funding_direction#1 funding_regime#1"
query("W48_funding_regime", _FRC, _fr_sql(f"avg(e.m) OVER {ALL}"))(lambda spark, d: OV.funding_regime(with_funding(spark, d), 48, 24))
query("W48_funding_regime_full", _FRC, _fr_sql("avg(e.m) OVER (PARTITION BY b.symbol)"))(lambda spark, d: OV.funding_regime(with_funding(spark, d), 48, 24, as_of="full"))


# ---- stateful regimes ------------------------------------------------------------------

def cusum_sql(limit, name):
    """Two sums that start again at 0 once they pass a limit, as a recursion under its own name."""
    return f"""
SELECT symbol, rn, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, NULL::DOUBLE AS sig FROM r4 WHERE rn = 0
UNION ALL SELECT symbol, rn, CASE WHEN u > {limit} THEN 0 ELSE u END, CASE WHEN u <= {limit} AND d < -{limit} THEN 0 ELSE d END, CASE WHEN u > {limit} OR d < -{limit} THEN 1 ELSE 0 END FROM (
SELECT s.symbol, s.rn, greatest(0, e.up + s.ret) AS u, least(0, e.dn + s.ret) AS d FROM {name} e JOIN r4 s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"""


cte("cu_e", cusum_sql(2, "cu_e"))


@query("W52_cusum", "symbol ts@ cusum_positive# cusum_negative# cusum_signal#1", """
SELECT r.symbol, r.ts, CASE WHEN r.rn > 0 THEN e.up END AS cusum_positive, CASE WHEN r.rn > 0 THEN abs(e.dn) END AS cusum_negative, e.sig AS cusum_signal FROM r4 r JOIN cu_e e ON e.symbol = r.symbol AND e.rn = r.rn""")
def _(spark, d):
    return RG.cusum(S.bars(spark, d), 2.0)


def _den(x, s):
    return f"CASE WHEN abs({x} / {s}) > 30 THEN 0 ELSE exp(-0.5 * pow({x} / {s}, 2)) / {s} END"


cte("hm0", "SELECT symbol, lo, greatest(q3 * 1.5, lo * 2) AS hi FROM (SELECT symbol, quantile_cont(abs(ret), 0.25) AS lo, quantile_cont(abs(ret), 0.75) AS q3 FROM r4 WHERE rn BETWEEN 1 AND 20 GROUP BY 1 HAVING count(ret) >= 20)")


def _hm_step(p, lo, hi, src):
    """One filter step as SQL over a source with r, p, lo, hi."""
    return f"""SELECT symbol, rn, pn AS p, CASE WHEN pn > 0.5 THEN lo ELSE lo2 END AS lo, CASE WHEN hx <= CASE WHEN pn > 0.5 THEN lo ELSE lo2 END THEN CASE WHEN pn > 0.5 THEN lo ELSE lo2 END * 2 ELSE hx END AS hi FROM (
SELECT *, sqrt(0.85 * lo * lo + 0.15 * r * r) AS lo2, CASE WHEN pn > 0.5 THEN sqrt(0.85 * hi * hi + 0.15 * r * r) ELSE hi END AS hx FROM (
SELECT *, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.5 END AS pn FROM (SELECT *, {_den('r', 'hi')} * (p * 0.85 + (1 - p) * 0.15) AS a, {_den('r', 'lo')} * ((1 - p) * 0.85 + p * 0.15) AS b FROM ({src}))))"""


cte("hm_e", _hm_step("p", "lo", "hi", f"SELECT s.symbol, s.rn, s.ret AS r, h.lo, h.hi, CASE WHEN ({_den('s.ret', 'h.hi')}) + ({_den('s.ret', 'h.lo')}) > 0 THEN ({_den('s.ret', 'h.hi')}) / (({_den('s.ret', 'h.hi')}) + ({_den('s.ret', 'h.lo')})) ELSE 0.5 END AS p FROM r4 s JOIN hm0 h USING (symbol) WHERE s.rn = 21")
    + " UNION ALL " + _hm_step("p", "lo", "hi", "SELECT s.symbol, s.rn, s.ret AS r, e.lo, e.hi, e.p FROM hm_e e JOIN r4 s ON s.symbol = e.symbol AND s.rn = e.rn + 1"))


# the stream has no first estimate: it begins with even odds
cte("hmo_e", _hm_step("p", "lo", "hi", "SELECT s.symbol, s.rn, s.ret AS r, h.lo, h.hi, 0.5::DOUBLE AS p FROM r4 s JOIN hm0 h USING (symbol) WHERE s.rn = 21")
    + " UNION ALL " + _hm_step("p", "lo", "hi", "SELECT s.symbol, s.rn, s.ret AS r, e.lo, e.hi, e.p FROM hmo_e e JOIN r4 s ON s.symbol = e.symbol AND s.rn = e.rn + 1"))


@query("W53_vol_state", "symbol ts@ hmm_vol_state#1 hmm_vol_probability#5", """
SELECT r.symbol, r.ts, CASE WHEN p > 0.5 THEN 1 WHEN p IS NOT NULL THEN 0 END AS hmm_vol_state, p AS hmm_vol_probability FROM r4 r LEFT JOIN hm_e h ON h.symbol = r.symbol AND h.rn = r.rn""")
def _(spark, d):
    return RG.vol_state(S.bars(spark, d))


cte("rgm", f"""
SELECT r.symbol, r.ts, c.sig AS cusum_signal, CASE WHEN h.p > 0.5 THEN 1 WHEN h.p IS NOT NULL THEN 0 END AS st, h.p, CASE WHEN r.rn >= 20 THEN CASE WHEN a <= v[7] THEN 0 WHEN a >= v[14] THEN 2 ELSE 1 END END AS vr
FROM (SELECT symbol, ts, rn, abs(ret) AS a, list_sort(list(coalesce(abs(ret), 0)) OVER {win(20)}) AS v FROM r4) r LEFT JOIN cu_e c ON c.symbol = r.symbol AND c.rn = r.rn LEFT JOIN hm_e h ON h.symbol = r.symbol AND h.rn = r.rn""")
cte("rgb", "SELECT *, coalesce(cusum_signal >= 0.5, false) AS b1x, coalesce(st >= 1, false) AS b2x, coalesce(vr >= 2, false) AS b3x, coalesce(p > 0.8, false) AS b4x FROM rgm")


def regimes(spark, d):
    b = S.bars(spark, d)
    x = RG.cusum(b, 2.0).select("symbol", "ts", "cusum_signal")
    y = RG.vol_state(b).select("symbol", "ts", "hmm_vol_state", "hmm_vol_probability")
    z = ft.on_bars(b, 21, ft.volatility_regime).select("symbol", "ts", "volatility_regime")
    j = z.join(x, ["symbol", "ts"]).join(y, ["symbol", "ts"])
    blocks = P.regime_blocks("cusum_signal", "hmm_vol_state", "volatility_regime", "hmm_vol_probability")
    j = j.withColumns(blocks)
    return j.withColumn("trade_allowed", P.trade_allowed({k: F.col(k) for k in blocks}))


@query("P15_regime_filter", "symbol ts@ trade_allowed?", "SELECT symbol, ts, NOT (b1x OR b2x OR b3x OR b4x) AS trade_allowed FROM rgb")
def _(spark, d):
    return regimes(spark, d)


@query("P16_regime_filter_breakdown", "symbol cusum_share# state_share# vol_share# prob_share# allowed_share#", """
SELECT symbol, avg(b1x::INT) AS cusum_share, avg(b2x::INT) AS state_share, avg(b3x::INT) AS vol_share, avg(b4x::INT) AS prob_share, avg((NOT (b1x OR b2x OR b3x OR b4x))::INT) AS allowed_share FROM rgb GROUP BY 1""")
def _(spark, d):
    s = lambda x: F.avg(F.col(x).cast("double"))
    return regimes(spark, d).groupBy("symbol").agg(s("blocked_by_cusum").alias("cusum_share"), s("blocked_by_hmm_state").alias("state_share"),
                                                   s("blocked_by_vol_regime").alias("vol_share"), s("blocked_by_hmm_prob").alias("prob_share"),
                                                   s("trade_allowed").alias("allowed_share"))


@query("W56_feature_set", "symbol ts@ log_return_N# atr_N# volume_ratio_N# bb_width# obi# obv_N#2 consecutive_up_N#1 doji_N# cvd#", f"""
SELECT t.symbol, t.ts, ln(t.close / lag(t.close, 12) OVER (PARTITION BY t.symbol ORDER BY t.ts)) AS "log_return_N", {roll('avg({})', 'tr', 14)} AS "atr_N", volume / nullif({roll('avg({})', 'volume', 24)}, 0) AS "volume_ratio_N", 4 * {roll('stddev_samp({})', 'close', 20)} / nullif({roll('avg({})', 'close', 20)}, 0) AS bb_width,
  CASE WHEN up + dn > 0 THEN (up - dn) / (up + dn) ELSE 0 END AS obi, sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER {ALL} AS "obv_N", rn - max(CASE WHEN close > open AND rn > 0 THEN NULL ELSE rn END) OVER {ALL} AS "consecutive_up_N",
  CASE WHEN rn >= 11 THEN avg(CASE WHEN high > low AND abs(close - open) / nullif(high - low, 0) <= 0.1 THEN 1.0 ELSE 0 END) OVER {win(12)} END AS "doji_N", cvd FROM tf4 t""")
def _(spark, d):
    return IN.feature_set(S.bars(spark, d), "SCALP")


cte("sw", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS kk FROM bars_4h) WHERE kk <= 50)")


def _lv(side):
    fn, col = ("max", "high") if side == "h" else ("min", "low")
    return f"""
SELECT symbol, avg(v) AS level FROM (SELECT symbol, v, sum(nw) OVER (PARTITION BY symbol ORDER BY v) AS grp FROM (SELECT symbol, v, CASE WHEN (v - lag(v) OVER (PARTITION BY symbol ORDER BY v)) / lag(v) OVER (PARTITION BY symbol ORDER BY v) < 0.003 THEN 0 ELSE 1 END AS nw FROM (
SELECT DISTINCT symbol, {col} AS v FROM (SELECT *, {fn}({col}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM sw) WHERE i >= 5 AND i < n - 5 AND {col} = m AND n >= 25))) GROUP BY symbol, grp"""


@query("W59_swing_levels", "symbol ts@ price#2 resistance#4 support#4 breakout_up? breakout_down? near_resistance? near_support? retest_support? bullish_sweep? bearish_sweep?", """
SELECT *, breakout_up AND near_support AS retest_support FROM (SELECT *, coalesce((resistance - price) / price < 0.005, false) AS near_resistance, coalesce((price - support) / price < 0.005, false) AS near_support, coalesce(low < support AND price > support, false) AS bullish_sweep, coalesce(high > resistance AND price < resistance, false) AS bearish_sweep FROM (
SELECT l.symbol, l.ts, l.close AS price, l.high, l.low, (SELECT min(level) FROM lvh h WHERE h.symbol = l.symbol AND level > l.close) AS resistance, (SELECT max(level) FROM lvl h WHERE h.symbol = l.symbol AND level < l.close) AS support,
  EXISTS (SELECT 1 FROM lvh h WHERE h.symbol = l.symbol AND l.pcx < level AND level <= l.close) AS breakout_up, EXISTS (SELECT 1 FROM lvl h WHERE h.symbol = l.symbol AND l.pcx > level AND level >= l.close) AS breakout_down
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pcx FROM sw) l WHERE l.i = l.n - 1))""", lvh=_lv("h"), lvl=_lv("l"))
def _(spark, d):
    return IN.swing_levels(S.bars(spark, d))


del late_z_sql, B
