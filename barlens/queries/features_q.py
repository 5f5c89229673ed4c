"""Queries: moving and recursive features (W1..W40, W45, W49, W51, W55)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from barlens.operators import features as ft, flow as fl
from barlens.operators.windows import (r_corr, r_cov, r_fraction, r_kurt, r_skew, r_slope,
                                       r_zscore, r_beta, lag, rolling_apply, RN)
from barlens.functions.core import div, ln
from barlens.plans.order_stats import Moving, moving, windows_through
from barlens.plans.ordered import frame
from barlens.plans.recurrence import ema, lookback_for
from barlens.queries.registry import cte, query
from barlens.sources import tables as S


def win(n: int, start: int | None = None, end: str = "CURRENT ROW") -> str:
    lo = f"{n - 1} PRECEDING" if start is None else f"{start} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {lo} AND {end})"


ALL = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def roll(fn: str, x: str, n: int, mp: int = 2, full: bool = True) -> str:
    """SQL twin of windows.roll; ``fn`` has {} for the argument."""
    cond = f"count({x}) OVER {win(n)} >= {mp}" + (f" AND rn >= {n - 1}" if full else "")
    return f"CASE WHEN {cond} THEN {fn.format(x)} OVER {win(n)} END"


def bars4(*groups, lookback, lookahead=0):
    return lambda spark, d: ft.on_bars(S.bars(spark, d), lookback, *groups, lookahead=lookahead)


def both(name, cols, sql, *groups, lookback, **ctes):
    query(name, cols, sql, **ctes)(bars4(*groups, lookback=lookback))


both("W1_rolling_stats", "symbol ts@ r_mean# r_sum# r_std# r_var# r_max# r_min# r_stdp#", f"""
SELECT symbol, ts, {roll('avg({})', 'close', 20)} AS r_mean, {roll('sum({})', 'close', 20)} AS r_sum,
       {roll('stddev_samp({})', 'close', 20)} AS r_std, {roll('var_samp({})', 'close', 20)} AS r_var,
       {roll('max({})', 'close', 20)} AS r_max, {roll('min({})', 'close', 20)} AS r_min,
       {roll('stddev_pop({})', 'close', 20)} AS r_stdp FROM b4""", ft.rolling_stats, lookback=20)

both("W2_rolling_apply", "symbol ts@ mad#", f"""
SELECT symbol, ts, CASE WHEN len(v) >= 10 THEN list_avg(list_transform(v, lambda x: abs(x - list_avg(v)))) END AS mad
FROM (SELECT symbol, ts, list(close) OVER {win(10)} AS v FROM b4)""",
     lambda x: x.withColumn("mad", rolling_apply("close", 10, lambda v: F.aggregate(
         F.transform(v, lambda q: F.abs(q - F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / F.size(v))),
         F.lit(0.0), lambda a, b: a + b) / F.size(v))), lookback=10)

both("UD3_rolling_function", "symbol ts@ trimmed#", f"""
SELECT symbol, ts, CASE WHEN rn >= 9 THEN list_avg(list_sort(v)[3:8]) END AS trimmed FROM (SELECT symbol, ts, rn, list(close) OVER {win(10)} AS v FROM b4)""",
     lambda x: windows_through(x, "trimmed", "close", 10, lambda v: np.sort(v, axis=1)[:, 2:8].mean(axis=1)), lookback=10)

both("W3_rolling_median", "symbol ts@ med#", f"""
SELECT symbol, ts, CASE WHEN rn >= 11 THEN median(high - low) OVER {win(12)} END AS med FROM b4""",
     lambda x: moving(x.withColumn("_rng", F.col("high") - F.col("low")), Moving("med", "_rng", "quantile", 12)), lookback=12)

both("W4_rolling_rank_pct", "symbol ts@ rank_pct#", f"""
SELECT symbol, ts, (len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2.0) / len(v) AS rank_pct
FROM (SELECT symbol, ts, close, list(close) OVER {win(30)} AS v FROM b4)""",
     lambda x: moving(x, Moving("rank_pct", "close", "rank", 30, full=False)), lookback=30)

both("W5_rolling_zscore", "symbol ts@ z1# z0#", f"""
SELECT symbol, ts, CASE WHEN s1 < 1e-14 THEN 0 ELSE (close - m) / s1 END AS z1,
       CASE WHEN s0 < 1e-14 THEN 0 ELSE (close - m) / s0 END AS z0
FROM (SELECT symbol, ts, close, {roll('avg({})', 'close', 20)} AS m, {roll('stddev_samp({})', 'close', 20)} AS s1,
             {roll('stddev_pop({})', 'close', 20)} AS s0 FROM b4)""",
     lambda x: x.withColumns({"z1": r_zscore("close", 20), "z0": r_zscore("close", 20, ddof=0)}), lookback=20)

both("W6_rolling_cov_corr", "symbol ts@ cov# corr#", f"""
SELECT symbol, ts, {roll('covar_samp({}, volume)', 'close', 20)} AS cov,
       CASE WHEN rn >= 19 AND stddev_pop(close) OVER {win(20)} >= 1e-14 AND stddev_pop(volume) OVER {win(20)} >= 1e-14
            THEN corr(close, volume) OVER {win(20)} END AS corr FROM b4""",
     lambda x: x.withColumns({"cov": r_cov("close", "volume", 20), "corr": r_corr("close", "volume", 20)}), lookback=20)

both("W7_rolling_ols_beta", "symbol ts@ beta#", f"""
SELECT symbol, ts, CASE WHEN rn >= 19 AND count(ret) OVER {win(20)} >= 5 AND var_pop(CASE WHEN ret IS NOT NULL THEN volume END) OVER {win(20)} >= 1e-14
       THEN regr_slope(ret, volume) OVER {win(20)} END AS beta FROM r4""",
     ft.base, lambda x: x.withColumn("beta", r_beta("ret", "volume", 20)), lookback=21)

both("W8_rolling_trend_slope", "symbol ts@ slope#", f"""
SELECT symbol, ts, CASE WHEN rn >= 9 THEN regr_slope(close, rn) OVER {win(10)} END AS slope FROM b4""",
     lambda x: x.withColumn("slope", r_slope("close", 10)), lookback=10)

both("W9_rolling_skew_kurt", "symbol ts@ skew# kurt#", f"""
SELECT symbol, ts, CASE WHEN n >= 8 THEN CASE WHEN v < 1e-300 THEN 0 ELSE sk END END AS skew,
       CASE WHEN n >= 8 AND v > 0 THEN ku END AS kurt
FROM (SELECT symbol, ts, count(ret) OVER w AS n, var_pop(ret) OVER w AS v,
             CASE WHEN count(ret) OVER w >= 3 THEN skewness(ret) OVER w END AS sk,
             CASE WHEN count(ret) OVER w >= 4 THEN kurtosis(ret) OVER w END AS ku
      FROM r4 WINDOW w AS {win(20)})""",
     ft.base, lambda x: x.withColumns({"skew": r_skew("ret", 20, 8), "kurt": r_kurt("ret", 20, 8)}), lookback=21)

both("W10_rolling_fraction", "symbol ts@ up_share#", f"""
SELECT symbol, ts, CASE WHEN rn >= 9 THEN avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) OVER {win(10)} END AS up_share FROM b4""",
     lambda x: x.withColumn("up_share", r_fraction(F.col("close") > F.col("open"), 10)), lookback=10)

both("W11_realized_vol", "symbol ts@ realized_vol#", f"""
SELECT symbol, ts, CASE WHEN rn >= 20 AND count(ret) OVER {win(20)} >= 2 THEN stddev_samp(ret) OVER {win(20)} * sqrt(2190.0::DOUBLE) END AS realized_vol FROM r4""",
     ft.base, ft.realized_vol, lookback=21)

both("W1b_returns_group", "symbol ts@ log_return_1# log_return_N# return_volatility_N# return_zscore_N#", f"""
SELECT symbol, ts, ret AS log_return_1, ln(close / p10) AS "log_return_N", sd AS "return_volatility_N",
       CASE WHEN ret IS NOT NULL AND m IS NOT NULL AND sd IS NOT NULL THEN
         CASE WHEN sd > CASE WHEN abs(m) > 1e-12 THEN abs(m) * 1e-6 ELSE 1e-10 END THEN (ret - m) / sd ELSE 0 END END AS "return_zscore_N"
FROM (SELECT symbol, ts, ret, close, lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts) AS p10,
             {roll('avg({})', 'ret', 20)} AS m, {roll('stddev_samp({})', 'ret', 20)} AS sd FROM r4)""",
     ft.returns_group, lookback=21)

_LN2 = "ln(2.0::DOUBLE)"
both("W12_parkinson_vol", "symbol ts@ parkinson_vol_N# rolling_parkinson#", f"""
SELECT symbol, ts, CASE WHEN p > 0 THEN sqrt(p / (4 * {_LN2})) END AS "parkinson_vol_N", sqrt(q / (4 * {_LN2})) AS rolling_parkinson
FROM (SELECT symbol, ts, {roll('avg({})', 'pow(ln(high / low), 2)', 20)} AS p, {roll('avg({})', 'pow(ln(high / low), 2)', 20, 1)} AS q FROM b4)""",
     ft.volatility_group, ft.parkinson_rolling, lookback=20)

both("W13_garman_klass_vol", "symbol ts@ garman_klass_vol_N#", f"""
SELECT symbol, ts, CASE WHEN g < 0 THEN 0 WHEN g >= 0 THEN sqrt(g) END AS "garman_klass_vol_N"
FROM (SELECT symbol, ts, {roll('avg({})', f'(0.5 * pow(ln(high / low), 2) - (2 * {_LN2} - 1) * pow(ln(close / open), 2))', 20)} AS g FROM b4)""",
     ft.volatility_group, lookback=20)

both("W14_high_low_range", "symbol ts@ high_low_range_N#", f"""
SELECT symbol, ts, {roll('avg({})', '((high - low) / nullif(close, 0))', 20)} AS "high_low_range_N" FROM b4""",
     ft.volatility_group, lookback=20)

both("W15_atr_sma", "symbol ts@ atr_N# atr_pct_N# atr_expansion_N#", f"""
SELECT symbol, ts, atr AS "atr_N", atr / nullif(close, 0) * 100 AS "atr_pct_N",
       atr / nullif({roll('avg({})', 'atr', 14)}, 0) AS "atr_expansion_N"
FROM (SELECT symbol, ts, rn, close, {roll('avg({})', 'tr', 14)} AS atr FROM r4)""", ft.atr_group, lookback=30)


def ema_sql(src: str, x: str, k: str, out: str, seed_rn: int = 0, seed: str | None = None) -> str:
    """Recursive row-by-row mean over table ``src`` (symbol, ts, rn, x); starts at row ``seed_rn``."""
    first = seed or x
    return f"""
SELECT symbol, rn, {first} AS {out} FROM {src} WHERE rn = {seed_rn}
UNION ALL
SELECT s.symbol, s.rn, s.{x} * ({k}) + e.{out} * (1 - ({k})) FROM {out}_e e JOIN {src} s ON s.symbol = e.symbol AND s.rn = e.rn + 1"""


def ema_cte(src, x, k, out, seed_rn=0, seed=None):
    return {f"{out}_e": ema_sql(src, x, k, out, seed_rn, seed)}


def sma_seed(x: str, n: int) -> str:
    return f"(SELECT avg(q.{x}) FROM {{src}} q WHERE q.symbol = {{src}}.symbol AND q.rn <= {n - 1})"


cte("s4", f"SELECT *, avg(close) OVER {ALL} AS cm, avg(CASE WHEN rn > 0 THEN tr END) OVER {ALL} AS tm FROM r4")

query("W16_atr_wilder", "symbol ts@ atr_wilder#", """
SELECT s.symbol, s.ts, a.a AS atr_wilder FROM s4 s LEFT JOIN a_e a ON a.symbol = s.symbol AND a.rn = s.rn""",
      **ema_cte("s4", "tr", "1.0::DOUBLE / 14", "a", 14, "tm"))(
    bars4(ft.base, ft.atr_wilder, lookback=lookback_for(1 / 14) + 15))

query("W17_ema", "symbol ts@ first_seed# sma_seed#", """
SELECT s.symbol, s.ts, f.f AS first_seed, m.m AS sma_seed FROM s4 s LEFT JOIN f_e f ON f.symbol = s.symbol AND f.rn = s.rn
LEFT JOIN m_e m ON m.symbol = s.symbol AND m.rn = s.rn""",
      **ema_cte("s4", "close", "2.0::DOUBLE / 27", "f"), **ema_cte("s4", "close", "2.0::DOUBLE / 13", "m", 11, "cm"))(
    bars4(lambda x: ema(x, "close", 2 / 27, "first_seed"),
          lambda x: ema(x, "close", 2 / 13, "sma_seed", seed="sma", n=12), lookback=lookback_for(2 / 27)))

query("W18_macd", "symbol ts@ macd# macd_signal# macd_histogram#", """
SELECT s.symbol, s.ts, m.macd, g.g AS macd_signal, m.macd - g.g AS macd_histogram FROM s4 s
LEFT JOIN mc m ON m.symbol = s.symbol AND m.rn = s.rn LEFT JOIN g_e g ON g.symbol = s.symbol AND g.rn = s.rn""",
      **ema_cte("s4", "close", "2.0::DOUBLE / 13", "f", 11, "cm"), **ema_cte("s4", "close", "2.0::DOUBLE / 27", "w", 25, "cm"),
      mc="""SELECT symbol, rn, macd, avg(macd) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS mm
            FROM (SELECT f.symbol, f.rn, f.f - w.w AS macd FROM f_e f JOIN w_e w ON f.symbol = w.symbol AND f.rn = w.rn)""",
      **ema_cte("mc", "macd", "2.0::DOUBLE / 10", "g", 33, "mm"))(
    bars4(ft.macd, lookback=ft.momentum_lookback()))

cte("gl4", """SELECT *, avg(g) OVER w AS gm, avg(l) OVER w AS lm FROM (
 SELECT symbol, ts, rn, CASE WHEN rn > 0 THEN greatest(close - pc, 0) END AS g, CASE WHEN rn > 0 THEN greatest(pc - close, 0) END AS l FROM r4)
 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
query("W19_rsi", "symbol ts@ rsi_N#", """
SELECT s.symbol, s.ts, CASE WHEN l.l = 0 THEN 100 ELSE 100 - 100 / (1 + g.g / nullif(l.l, 0)) END AS "rsi_N" FROM s4 s
LEFT JOIN g_e g ON g.symbol = s.symbol AND g.rn = s.rn LEFT JOIN l_e l ON l.symbol = s.symbol AND l.rn = s.rn""",
      **ema_cte("gl4", "g", "1.0::DOUBLE / 14", "g", 14, "gm"), **ema_cte("gl4", "l", "1.0::DOUBLE / 14", "l", 14, "lm"))(
    bars4(ft.rsi, lookback=lookback_for(1 / 14) + 15))

both("W20_bollinger", "symbol ts@ bb_upper# bb_lower# bb_position# bb_width#", f"""
SELECT symbol, ts, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, (close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0) AS bb_position,
       ((m + 2 * s) - (m - 2 * s)) / nullif(m, 0) AS bb_width
FROM (SELECT symbol, ts, close, {roll('avg({})', 'close', 20)} AS m, {roll('stddev_samp({})', 'close', 20)} AS s FROM b4)""",
     ft.bollinger, lookback=20)

both("W21_range_breakout", "symbol ts@ highest_N# lowest_N# range_breakout_N#", f"""
SELECT symbol, ts, h AS "highest_N", l AS "lowest_N", (close - l) / nullif(h - l, 0) AS "range_breakout_N"
FROM (SELECT symbol, ts, close, {roll('max({})', 'high', 20, 1)} AS h, {roll('min({})', 'low', 20, 1)} AS l FROM b4)""",
     ft.range_breakout, lookback=20)


def late_z_sql(x: str, n: int) -> str:
    return (f"CASE WHEN rn >= {n} AND count({x}) OVER {win(n)} > 5 AND stddev_pop({x}) OVER {win(n)} > 1e-10 "
            f"THEN ({x} - avg({x}) OVER {win(n)}) / stddev_pop({x}) OVER {win(n)} END")


both("W22_volume_ratio", "symbol ts@ volume_ratio_N# volume_trend_N# volume_zscore_spike#", f"""
SELECT symbol, ts, volume / nullif({roll('avg({})', 'volume', 20)}, 0) AS "volume_ratio_N",
       CASE WHEN rn >= 19 THEN regr_slope(volume, rn) OVER {win(20)} END AS "volume_trend_N",
       {late_z_sql('volume', 24)} AS volume_zscore_spike FROM b4""",
     ft.volume_ratio_group, ft.volume_zscore_spike, lookback=25)

both("W23_vwap_cum", "symbol ts@ vwap_cum# vwap_deviation#", f"""
SELECT symbol, ts, v AS vwap_cum, (close - v) / nullif(v, 0) AS vwap_deviation FROM (
  SELECT symbol, ts, close, sum(tp * volume) OVER {ALL} / nullif(sum(volume) OVER {ALL}, 0) AS v FROM r4)""",
     ft.volume_cumulative, lookback=1)

both("W24_vwap_rolling", "symbol ts@ vwap_rolling# vamp_N# vwap_mid_deviation_N#", f"""
SELECT symbol, ts, CASE WHEN rn >= 19 THEN sum(tp * volume) OVER {win(20)} / nullif(sum(volume) OVER {win(20)}, 0) END AS vwap_rolling,
       CASE WHEN rn >= 4 THEN sum(mid * volume) OVER {win(5)} / sum(volume) OVER {win(5)} END AS "vamp_N",
       CASE WHEN rn >= 9 THEN (mid - vw) / vw END AS "vwap_mid_deviation_N"
FROM (SELECT *, sum(tp * volume) OVER {win(10)} / nullif(sum(volume) OVER {win(10)}, 0) AS vw FROM r4)""",
     ft.vwap_rolling, fl.vwap_windows, lookback=20)

both("W25_obv", "symbol ts@ obv_N#", f"""
SELECT symbol, ts, sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER {ALL} AS "obv_N" FROM r4""",
     ft.volume_cumulative, lookback=1)

cte("tf4", f"""
SELECT *, sum(tb - (volume - tb)) OVER (PARTITION BY symbol, rn // 24 ORDER BY ts) AS cvd, tb / nullif(volume, 0) AS tbr
FROM (SELECT *, least(greatest(volume * (close - low) / CASE WHEN high > low THEN high - low ELSE 1e-10 END, 0), volume) AS tb FROM r4)""")
both("W26_cvd", "symbol ts@ cvd# taker_buy_ratio#", "SELECT symbol, ts, cvd, tbr AS taker_buy_ratio FROM tf4",
     ft.taker_flow_group, lookback=72)
both("W27_cvd_divergence", "symbol ts@ cvd_divergence# taker_imbalance_zscore# price_velocity_5bar# price_velocity_10bar#", f"""
SELECT symbol, ts, {late_z_sql('cvd', 48)} - {late_z_sql('close', 48)} AS cvd_divergence,
       {late_z_sql('tbr', 24)} AS taker_imbalance_zscore,
       close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS price_velocity_5bar,
       close / lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS price_velocity_10bar FROM tf4""",
     ft.taker_flow_group, lookback=72)

both("W28_consecutive", "symbol ts@ consecutive_up_N# consecutive_dn_N#", f"""
SELECT symbol, ts, rn - max(CASE WHEN close > open AND rn > 0 THEN NULL ELSE rn END) OVER {ALL} AS "consecutive_up_N",
       rn - max(CASE WHEN close < open AND rn > 0 THEN NULL ELSE rn END) OVER {ALL} AS "consecutive_dn_N" FROM b4""",
     ft.streaks, lookback=1)

both("W29_trend_group", "symbol ts@ trend_ma_short_slope# trend_ma_long_slope# trend_ma_cross# trend_position#", f"""
SELECT symbol, ts, CASE WHEN rn >= 29 THEN regr_slope(ms, rn) OVER {win(10)} END AS trend_ma_short_slope,
       CASE WHEN rn >= 119 THEN regr_slope(ml, rn) OVER {win(40)} END AS trend_ma_long_slope,
       (ms / ml - 1) * 100 AS trend_ma_cross, (close / ml - 1) * 100 AS trend_position
FROM (SELECT *, {roll('avg({})', 'close', 20, 20)} AS ms, {roll('avg({})', 'close', 80, 80)} AS ml FROM b4)""",
     lambda x: ft.trend_group(x, 20, 80), lookback=130)

both("W30_spread_pct", "symbol ts@ spread_pct_N# quoted_spread_N#", f"""
SELECT symbol, ts, {roll('avg({})', '((high - low) / nullif(close, 0))', 10)} AS "spread_pct_N",
       {roll('avg({})', '(2 * abs(close - mid) / nullif(mid, 0))', 10)} AS "quoted_spread_N" FROM r4""",
     fl.spread_group, lookback=10)

cte("ob4", "SELECT *, CASE WHEN up + dn > 0 THEN (up - dn) / (up + dn) ELSE 0 END AS obi FROM r4")
both("W31_imbalance_vpin_ofi", "symbol ts@ volume_imbalance_N# vpin_N# ofi_N# depth_ratio_N#2", f"""
SELECT symbol, ts, CASE WHEN rn >= 9 THEN sum(up - dn) OVER {win(10)} / sum(up + dn) OVER {win(10)} END AS "volume_imbalance_N",
       CASE WHEN rn >= 49 THEN sum(abs(up - dn)) OVER {win(50)} / sum(up + dn) OVER {win(50)} END AS "vpin_N",
       {roll('avg({})', 'obi', 10)} AS "ofi_N", {roll('avg({})', '(up / greatest(dn, 1e-10))', 5)} AS "depth_ratio_N" FROM ob4""",
     ft.base, fl.imbalance_group, lookback=50)

_W = [math.exp(-0.8 * k) for k in range(5)]
both("W32_multi_level_obi", "symbol ts@ multi_level_obi_N#", f"""
SELECT symbol, ts, CASE WHEN rn >= 14 THEN ({' + '.join(f'avg(obi) OVER {win(3 * (k + 1))} * {w!r}::DOUBLE' for k, w in enumerate(_W))}) / {sum(_W)!r}::DOUBLE END AS "multi_level_obi_N" FROM ob4""",
     fl.multi_level_obi, lookback=15)

both("W33_intensity_hhi", "symbol ts@ trade_intensity_N# trade_count_N# volume_concentration_hhi_N#", f"""
SELECT symbol, ts, CASE WHEN mu > 0 AND raw >= 0 THEN raw / mu END AS "trade_intensity_N",
       CASE WHEN sd > 1e-14 THEN (volume - {roll('avg({})', 'volume', 20, 3)}) / sd END AS "trade_count_N",
       CASE WHEN rn >= 19 THEN sum(volume * volume) OVER {win(20)} / pow(sum(volume) OVER {win(20)}, 2) END AS "volume_concentration_hhi_N"
FROM (SELECT *, {roll('avg({})', 'raw', 10)} AS mu, {roll('stddev_samp({})', 'volume', 20, 3)} AS sd
      FROM (SELECT *, volume * (high - low) / nullif(close, 0) AS raw FROM b4))""", fl.intensity_group, lookback=20)

both("W34_amihud", "symbol ts@ amihud_illiquidity_N#9", f"""
SELECT symbol, ts, {roll('avg({})', '(abs(ret) / nullif(close * volume, 0))', 15, 1)} AS "amihud_illiquidity_N" FROM r4""",
     fl.amihud, lookback=16)

both("W35_roll_spread", "symbol ts@ roll_spread_N# roll_spread_population#", f"""
SELECT symbol, ts, CASE WHEN rn >= 20 AND count(dx) OVER {win(20)} >= 3 THEN 2 * sqrt(greatest(0, -covar_samp(dx, dl) OVER {win(20)})) END AS "roll_spread_N",
       CASE WHEN rn >= 20 AND count(dx) OVER {win(20)} >= 2 THEN 2 * sqrt(greatest(0, -covar_pop(dx, dl) OVER {win(20)})) END AS roll_spread_population
FROM (SELECT *, CASE WHEN dl IS NOT NULL THEN d END AS dx FROM (SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY ts) AS dl FROM (SELECT *, close - pc AS d FROM r4)))""",
     fl.roll_spread, lambda x: fl.roll_spread(x, variant="population"), lookback=22)

both("W36_microstructure_noise", "symbol ts@ microstructure_noise_N#", f"""
SELECT symbol, ts, CASE WHEN s1 > 1e-14 AND sn > 1e-14 THEN least(greatest(sqrt(20.0::DOUBLE) * s1 / sn, 0.01), 10) END AS "microstructure_noise_N"
FROM (SELECT symbol, ts, {roll('stddev_samp({})', 'ret', 20, 3)} AS s1, {roll('stddev_samp({})', 'rw', 20, 3)} AS sn
      FROM (SELECT *, CASE WHEN rn >= 20 THEN sum(ret) OVER {win(20)} END AS rw FROM r4))""", fl.noise, lookback=42)

both("W37_serial_corr", "symbol ts@ serial_correlation_N#", f"""
SELECT symbol, ts, CASE WHEN rn >= 11 AND count(rl) OVER {win(10)} >= 4 AND var_pop(rl) OVER {win(10)} * 100 >= 1e-14 AND var_pop(ret) OVER {win(10)} * 100 >= 1e-14
       THEN least(1, greatest(-1, corr(rl, ret) OVER {win(10)})) END AS "serial_correlation_N"
FROM (SELECT *, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS rl FROM r4)""", fl.serial_corr, lookback=13)

both("W38_price_impact_slope", "symbol ts@ price_impact_slope_N#", f"""
SELECT symbol, ts, CASE WHEN rn >= 15 AND var_pop(up - dn) OVER {win(15)} * 225 >= 1e-14 THEN regr_slope(ret, up - dn) OVER {win(15)} END AS "price_impact_slope_N" FROM r4""",
     fl.price_impact, lookback=16)

both("W39_microprice", "symbol ts@ microprice_N# micro_price_stoikov_N#", f"""
SELECT symbol, ts, {roll('avg({})', 'own', 5)} AS "microprice_N", {roll('avg({})', 'crossed', 5)} AS "micro_price_stoikov_N"
FROM (SELECT *, CASE WHEN up + dn > 0 THEN low * (1 - up / (up + dn)) + high * up / (up + dn) ELSE mid END AS own,
             CASE WHEN up + dn > 0 THEN (low * up + high * dn) / (up + dn) ELSE mid END AS crossed FROM r4)""",
     fl.microprice_group, lookback=5)

both("W40_liquidity_vacuum", "symbol ts@ liquidity_vacuum_N#", f"""
SELECT symbol, ts, greatest(0, 1 - volume / vm) * (greatest(1, sp / sm) - 1) AS "liquidity_vacuum_N"
FROM (SELECT *, {roll('avg({})', 'volume', 10)} AS vm, nullif({roll('avg({})', 'sp', 10)}, 0) AS sm
      FROM (SELECT *, (high - low) / nullif(close, 0) AS sp FROM b4)) WHERE vm IS NOT NULL AND sm IS NOT NULL
UNION ALL
SELECT symbol, ts, NULL FROM (SELECT *, {roll('avg({})', 'volume', 10)} AS vm, nullif({roll('avg({})', '((high - low) / nullif(close, 0))', 10)}, 0) AS sm FROM b4)
WHERE vm IS NULL OR sm IS NULL""", fl.liquidity_vacuum, lookback=10)

both("W45_scalp_momentum", "symbol ts@ mom_quality# mom_acceleration# mom_consistency# mom_range_expansion# mom_micro_trend# mom_volume_surge# mom_divergence#", f"""
SELECT symbol, ts, CASE WHEN rn >= 12 THEN CASE WHEN sd > 1e-10 THEN abs(ret) / sd ELSE 0 END END AS mom_quality,
       ret - lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS mom_acceleration,
       CASE WHEN rn >= 11 THEN count(CASE WHEN ret > 0 THEN 1 END) OVER {win(12)} / 12.0 END AS mom_consistency,
       CASE WHEN rn >= 12 THEN CASE WHEN rm > 1e-10 THEN (high - low) / rm ELSE 1 END END AS mom_range_expansion,
       {roll('avg({})', 'ret', 6, 6)} - {roll('avg({})', 'ret', 12, 12)} AS mom_micro_trend,
       CASE WHEN rn >= 12 THEN CASE WHEN vm > 1e-10 THEN volume / vm ELSE 1 END END AS mom_volume_surge,
       CASE WHEN rn >= 11 THEN CASE WHEN ret > 0 THEN abs(close / mx - 1) WHEN ret < 0 THEN -abs(close / mx - 1) ELSE 0 END END AS mom_divergence
FROM (SELECT *, CASE WHEN count(ret) OVER {win(12)} = 12 THEN stddev_samp(ret) OVER {win(12)} END AS sd, median(high - low) OVER {win(12)} AS rm,
             median(volume) OVER {win(12)} AS vm, max(close) OVER {win(12)} AS mx FROM r4)""",
     ft.scalp_momentum_group, lookback=13)

both("W49_classify_regime", "symbol ts@ regime confidence# sma_50# atr_pct# slope#", f"""
SELECT symbol, ts, CASE WHEN sma IS NULL OR sl IS NULL THEN 'TRANSITION' WHEN close > sma AND sl > 0 THEN 'TREND_UP'
         WHEN close < sma AND sl < 0 THEN 'TREND_DOWN' WHEN ap < 0.02 THEN 'RANGE' ELSE 'TRANSITION' END AS regime,
       CASE WHEN sma IS NULL OR sl IS NULL THEN 0 WHEN (close > sma AND sl > 0) OR (close < sma AND sl < 0) THEN least(1, abs(sl) * 1000 / close)
         WHEN ap < 0.02 THEN greatest(0.3, 1 - ap / 0.02) ELSE 0.5 END AS confidence, sma AS sma_50, ap AS atr_pct, sl AS slope
FROM (SELECT *, {roll('avg({})', 'close', 50, 50)} AS sma, CASE WHEN rn >= 14 THEN avg(CASE WHEN rn > 0 THEN tr END) OVER {win(14)} / close END AS ap,
             CASE WHEN rn >= 9 THEN regr_slope(close, rn) OVER {win(10)} END AS sl FROM r4)""", ft.classify_regime, lookback=50)


def _regimes(spark, d):
    return ft.on_bars(S.bars(spark, d), 50, ft.classify_regime)


_REG = f"""SELECT symbol, ts, CASE WHEN sma IS NULL OR sl IS NULL THEN 'TRANSITION' WHEN close > sma AND sl > 0 THEN 'TREND_UP'
  WHEN close < sma AND sl < 0 THEN 'TREND_DOWN' WHEN ap < 0.02 THEN 'RANGE' ELSE 'TRANSITION' END AS regime
FROM (SELECT *, {roll('avg({})', 'close', 50, 50)} AS sma, CASE WHEN rn >= 14 THEN avg(CASE WHEN rn > 0 THEN tr END) OVER {win(14)} / close END AS ap,
             CASE WHEN rn >= 9 THEN regr_slope(close, rn) OVER {win(10)} END AS sl FROM r4)"""
cte("regimes4", _REG)


@query("W50_regime_counts", "symbol regime n!", "SELECT symbol, regime, count(*) AS n FROM regimes4 GROUP BY ALL")
def _(spark, d):
    return _regimes(spark, d).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"))


@query("W50_regime_transitions", "symbol transitions!", """
SELECT symbol, count(CASE WHEN regime <> p THEN 1 END) AS transitions
FROM (SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM regimes4) GROUP BY symbol""")
def _(spark, d):
    x = ft.on_bars(_regimes(spark, d).select("symbol", "ts", "regime"), 1,
                   lambda y: y.withColumn("changed", F.col("regime") != lag("regime")))
    return x.groupBy("symbol").agg(F.count_if("changed").alias("transitions"))


both("W51_volatility_regime", "symbol ts@ volatility_regime#", f"""
SELECT symbol, ts, CASE WHEN rn >= 20 THEN CASE WHEN n >= 5 AND a <= v[7] THEN 0 WHEN n >= 5 AND a >= v[14] THEN 2 ELSE 1 END END AS volatility_regime
FROM (SELECT symbol, ts, rn, abs(ret) AS a, count(ret) OVER {win(20)} AS n, list_sort(list(coalesce(abs(ret), 0)) OVER {win(20)}) AS v FROM r4)""",
     ft.volatility_regime, lookback=21)

query("W55_extended_alpha", "symbol ts@ vol_price_ratio#2 range_percentile# volume_percentile# price_momentum_12h# volume_momentum_12h# momentum_divergence# trend_4h# trend_1d# trend_alignment#", f"""
SELECT *, pm AS price_momentum_12h, vm AS volume_momentum_12h, pm - vm AS momentum_divergence, sign(trend_4h) * sign(trend_1d) AS trend_alignment FROM (
SELECT symbol, ts, volume / rng AS vol_price_ratio,
       CASE WHEN rn >= 20 THEN len(list_filter(pr, lambda x: x < rng)) / len(pr) * 100 END AS range_percentile,
       CASE WHEN rn >= 20 THEN len(list_filter(pv, lambda x: x < volume)) / len(pv) * 100 END AS volume_percentile,
       CASE WHEN rn >= 12 THEN close / p12 - 1 ELSE 0 END AS pm,
       CASE WHEN rn >= 12 THEN volume / md - 1 ELSE 0 END AS vm,
       CASE WHEN rn >= 48 THEN close / m48 - 1 ELSE 0 END AS trend_4h, CASE WHEN rn >= 192 THEN close / m192 - 1 ELSE 0 END AS trend_1d
FROM (SELECT *, list(rng) OVER {win(0, 20, '1 PRECEDING')} AS pr, list(volume) OVER {win(0, 20, '1 PRECEDING')} AS pv,
             lag(close, 12) OVER (PARTITION BY symbol ORDER BY ts) AS p12, median(volume) OVER {win(0, 12, '1 PRECEDING')} AS md,
             avg(close) OVER {win(0, 48, '1 PRECEDING')} AS m48, avg(close) OVER {win(0, 192, '1 PRECEDING')} AS m192
      FROM (SELECT *, high - low + 1e-10 AS rng FROM b1)))""")(
    lambda spark, d: ft.on_bars(S.bars(spark, d, "1 hour"), 193, ft.extended_alpha_group))
