"""Queries: cross-section (X*), factors (F*) and evaluation (E*)."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from barlens.functions.core import div, ln
from barlens.operators import cross as X, evaluation as E, factors as FA, features as ft, timegrid as T
from barlens.operators.windows import RN, lag, r_std, r_sum
from barlens.plans.ordered import blocked, core_rows
from barlens.queries.features_q import ema_cte, roll, win
from barlens.queries.registry import cte, query
from barlens.sources import tables as S

BENCH = S.BENCH


def panel(spark, d):
    return T.align_union(S.bars(spark, d))


def ret4(spark, d, lookback=21, *groups):
    return ft.on_bars(S.bars(spark, d), lookback, ft.base, *groups)


def rank_avg_sql(x: str, by: str = "ts") -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) "
            f"+ (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END")


@query("X1_cs_rank_pct", "symbol ts@ r#", f"""
SELECT symbol, ts, ({rank_avg_sql('trade_count')}) / count(trade_count) OVER (PARTITION BY ts) AS r FROM bars_4h""")
def _(spark, d):
    return S.bars(spark, d).withColumn("r", X.cs_rank_pct("trade_count"))


_POS = "row_number() OVER (PARTITION BY ts ORDER BY {x} NULLS LAST, symbol) - 1"


@query("X2_cs_rank_unit", "symbol ts@ r#", f"""
SELECT symbol, ts, CASE WHEN volume IS NULL THEN NULL WHEN count(volume) OVER (PARTITION BY ts) = 1 THEN 0.5
       ELSE ({_POS.format(x='volume')}) / (count(volume) OVER (PARTITION BY ts) - 1) END AS r FROM panel""")
def _(spark, d):
    return panel(spark, d).withColumn("r", X.cs_rank_unit("volume"))


@query("X3_cs_rank_center", "symbol ts@ r#", f"""
SELECT symbol, ts, CASE WHEN count(*) OVER (PARTITION BY ts) >= 3 THEN ({_POS.format(x='close')} + 0.5) / count(*) OVER (PARTITION BY ts) ELSE close END AS r FROM bars_4h""")
def _(spark, d):
    return S.bars(spark, d).withColumn("r", X.cs_rank_center("close"))


def _rc(x):
    return f"CASE WHEN count(*) OVER (PARTITION BY ts) >= 3 THEN ({_POS.format(x=x)} + 0.5) / count(*) OVER (PARTITION BY ts) ELSE {x} END"


@query("X3_cs_rank_matrix", "symbol ts@ close# volume# high#", f"SELECT symbol, ts, {_rc('close')} AS close, {_rc('volume')} AS volume, {_rc('high')} AS high FROM bars_4h")
def _(spark, d):
    return X.cs_rank_matrix(S.bars(spark, d), ["close", "volume", "high"])


@query("X4_cs_zscore", "symbol ts@ z#", """
SELECT symbol, ts, (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) AS z FROM bars_4h WINDOW w AS (PARTITION BY ts)""")
def _(spark, d):
    return S.bars(spark, d).withColumn("z", X.cs_zscore("close"))


cte("rp", "SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM pn")
cte("rmed", "SELECT *, median(ret) OVER (PARTITION BY ts) AS med FROM rp")


@query("X5_corr_with_median", "symbol ts@ correlation_with_median# correlation_zscore#", f"""
SELECT symbol, ts, c AS correlation_with_median, CASE WHEN rn >= 19 AND count(c) OVER {win(20)} >= 2 AND c IS NOT NULL THEN CASE WHEN stddev_pop(c) OVER {win(20)} < 1e-14 THEN 0
       ELSE (c - avg(c) OVER {win(20)}) / stddev_pop(c) OVER {win(20)} END END AS correlation_zscore FROM (
SELECT symbol, ts, rn, CASE WHEN rn >= 19 AND count(ret) OVER {win(20)} >= 5 AND stddev_pop(ret) OVER {win(20)} >= 1e-14 AND stddev_pop(CASE WHEN ret IS NOT NULL THEN med END) OVER {win(20)} >= 1e-14
       THEN corr(ret, med) OVER {win(20)} END AS c FROM rmed)""")
def _(spark, d):
    x = core_rows(ft.base(blocked(panel(spark, d), 1)))
    m = X.universe_median(x, "ret", "median_ret")
    return core_rows(X.corr_with_median(blocked(x.join(m, "ts"), 42)))


def _unit_sql(x):
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN count({x}) OVER (PARTITION BY ts) = 1 THEN 0.5 "
            f"ELSE ({_POS.format(x=x)}) / (count({x}) OVER (PARTITION BY ts) - 1)::DOUBLE END")


@query("X6_rank_group", "symbol ts@ rank_momentum_1h# rank_momentum_4h# rank_momentum_24h# rank_volatility# rank_volume#", f"""
SELECT symbol, ts, {_unit_sql('m1')} AS rank_momentum_1h, {_unit_sql('m2')} AS rank_momentum_4h, {_unit_sql('m3')} AS rank_momentum_24h,
       {_unit_sql('v')} AS rank_volatility, {_unit_sql('volume')} AS rank_volume
FROM (SELECT symbol, ts, volume, close / lag(close, 6) OVER w - 1 AS m1, close / lag(close, 24) OVER w - 1 AS m2, close / lag(close, 144) OVER w - 1 AS m3,
             {roll('stddev_pop({})', 'ret', 20)} AS v FROM rp WINDOW w AS (PARTITION BY symbol ORDER BY ts))""")
def _(spark, d):
    b = ft.base(blocked(panel(spark, d), 145))
    b = b.withColumns({"mom_1": div("close", lag("close", 6)) - 1.0, "mom_2": div("close", lag("close", 24)) - 1.0,
                       "mom_3": div("close", lag("close", 144)) - 1.0, "vol": r_std("ret", 20, ddof=0)})
    return X.rank_group(core_rows(b))


@query("X7_cs_momentum", "symbol ts@ cs_momentum_5# cs_momentum_10# cs_momentum_20#", f"""
SELECT symbol, ts, {_unit_sql('s5')} AS cs_momentum_5, {_unit_sql('s10')} AS cs_momentum_10, {_unit_sql('s20')} AS cs_momentum_20
FROM (SELECT symbol, ts, {roll('sum({})', 'ret', 5)} AS s5, {roll('sum({})', 'ret', 10)} AS s10, {roll('sum({})', 'ret', 20)} AS s20 FROM rp)""")
def _(spark, d):
    b = ft.base(blocked(panel(spark, d), 21))
    b = b.withColumns({f"s{n}": X.windowed_return(n) for n in (5, 10, 20)})
    return core_rows(b).withColumns({f"cs_momentum_{n}": X.cs_rank_unit(f"s{n}") for n in (5, 10, 20)})


cte("rb", f"SELECT r.*, b.ret AS bret FROM rp r LEFT JOIN (SELECT ts, ret FROM rp WHERE symbol = '{BENCH}') b ON b.ts = r.ts")
cte("resid", f"""
SELECT *, ret - beta * bret AS residual FROM (SELECT *, CASE WHEN rn >= 19 AND count(CASE WHEN bret IS NOT NULL THEN ret END) OVER {win(20)} >= 5
  AND var_pop(CASE WHEN ret IS NOT NULL THEN bret END) OVER {win(20)} >= 1e-14 THEN regr_slope(ret, bret) OVER {win(20)} END AS beta FROM rb)""")


def _resid(spark, d):
    x = core_rows(ft.base(blocked(panel(spark, d), 1)))
    return core_rows(X.residual_return(blocked(X.with_benchmark(x, BENCH, {"ret": "bench_ret"}), 20)))


@query("X8_residual_return", "symbol ts@ residual_beta# residual_momentum#", """
SELECT symbol, ts, beta AS residual_beta, residual AS residual_momentum FROM resid""")
def _(spark, d):
    return _resid(spark, d)


@query("X9_symbol_profiles", "symbol beta# vol# mom#", """
SELECT symbol, coalesce(arg_max(beta, ts) FILTER (WHERE beta IS NOT NULL), 0) AS beta,
       coalesce(stddev_samp(ret) FILTER (WHERE kn <= 20 AND ret IS NOT NULL), 0) AS vol, coalesce(sum(residual) FILTER (WHERE k5 <= 5 AND residual IS NOT NULL), 0) AS mom
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY (residual IS NULL), ts DESC) AS k5, row_number() OVER (PARTITION BY symbol ORDER BY (ret IS NULL), ts DESC) AS kn FROM resid)
GROUP BY symbol""")
def _(spark, d):
    return X.symbol_profiles(_resid(spark, d))


@query("X9_cluster_symbols", "symbol cluster_id!")
def _(spark, d):
    return X.cluster_symbols(X.symbol_profiles(_resid(spark, d)).filter(F.col("symbol") != BENCH), ["beta", "vol", "mom"])


@query("X9_cluster_embeddings", "cluster_id! n!")
def _(spark, d):
    from pyspark.ml.functions import array_to_vector
    e = S.load(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return X.cluster_symbols(e, ["v"], 4).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark, d, n=20):
    x = core_rows(ft.base(blocked(panel(spark, d), 1)))
    x = X.with_benchmark(x, BENCH, {"ret": "ctx_ret"}).filter(F.col("symbol") != BENCH)
    return core_rows(X.lead_lag_group(blocked(x, n + 5, 5), n, 3, n))


cte("pr", f"SELECT * FROM rb WHERE symbol <> '{BENCH}'")


def corr_sql(a, b, n, mp=5):
    """Complete-pair correlation over the last n rows."""
    x, y = f"(CASE WHEN {b} IS NOT NULL THEN {a} END)", f"(CASE WHEN {a} IS NOT NULL THEN {b} END)"
    return (f"CASE WHEN rn >= {n - 1} AND count({x}) OVER {win(n)} >= {mp} AND stddev_pop({x}) OVER {win(n)} >= 1e-14 "
            f"AND stddev_pop({y}) OVER {win(n)} >= 1e-14 THEN corr({x}, {y}) OVER {win(n)} END")


_P, _Q = "(CASE WHEN bret IS NOT NULL THEN ret END)", "(CASE WHEN ret IS NOT NULL THEN bret END)"


@query("X10_relative_strength", "symbol ts@ relative_strength#4", f"""
SELECT symbol, ts, CASE WHEN rn >= 19 AND n >= 2 AND abs(exp(c) - 1) >= 1e-10 THEN (exp(p) - 1) / (exp(c) - 1) END AS relative_strength
FROM (SELECT *, count({_P}) OVER {win(20)} AS n, sum({_P}) OVER {win(20)} AS p, sum({_Q}) OVER {win(20)} AS c FROM pr)""")
def _(spark, d):
    return _pairs(spark, d)


@query("X11_rolling_pair_corr", "symbol ts@ correlation_pairwise#", f"SELECT symbol, ts, {corr_sql('ret', 'bret', 20)} AS correlation_pairwise FROM pr")
def _(spark, d):
    return _pairs(spark, d)


@query("X12_lead_lag_score", "symbol ts@ lead_lag_score#", f"""
SELECT symbol, ts, best.a * best.s AS lead_lag_score FROM (SELECT symbol, ts, CASE WHEN rn >= 22 THEN (list_max(list_filter([{', '.join(f"{{'a': abs(k{k + 3}), 'o': {-(k + 3)}, 's': {float((k > 0) - (k < 0))}}}" for k in range(-3, 4))}], lambda z: z.a IS NOT NULL))) END AS best
FROM (SELECT symbol, ts, rn, {', '.join(f"CASE WHEN {'true' if k >= 0 else f'rn <= last + {k}'} THEN {corr_sql('ret', f'c{k + 3}', 20)} END AS k{k + 3}" for k in range(-3, 4))}
      FROM (SELECT *, max(rn) OVER (PARTITION BY symbol) AS last, {', '.join(f"lag(bret, {k}) OVER w AS c{k + 3}" if k >= 0 else f"lead(bret, {-k}) OVER w AS c{k + 3}" for k in range(-3, 4))}
            FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY ts))))""")
def _(spark, d):
    return _pairs(spark, d)


@query("X13_tf_alignment", "symbol ts@ tf_alignment#", f"""
SELECT symbol, ts, CASE WHEN rn >= 20 AND cv >= 1e-14 THEN 4 / pi() * atan(pv / cv) - 1 END AS tf_alignment
FROM (SELECT *, {roll('stddev_samp({})', 'ret', 20)} AS pv, {roll('stddev_samp({})', 'bret', 20)} AS cv FROM pr)""")
def _(spark, d):
    return _pairs(spark, d)


# clusters of five symbols, by their number
_CL = "CAST(substr({}, 2) AS INT) // 5"
_WP = "(PARTITION BY p.symbol, o.symbol ORDER BY p.ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_PA, _PB = "(CASE WHEN o.ret IS NOT NULL THEN p.ret END)", "(CASE WHEN p.ret IS NOT NULL THEN o.ret END)"


@query("X14_cluster_rotation", "symbol ts@ cluster_rotation#", f"""
SELECT symbol, ts, CASE WHEN count(r) > 0 THEN least(1, greatest(0, 1 - avg(r))) END AS cluster_rotation FROM (
SELECT p.symbol, p.ts, CASE WHEN p.rn >= 19 AND count({_PA}) OVER {_WP} >= 5 AND stddev_pop({_PA}) OVER {_WP} >= 1e-14 AND stddev_pop({_PB}) OVER {_WP} >= 1e-14
  THEN corr({_PA}, {_PB}) OVER {_WP} END AS r
FROM rp p JOIN rp o ON o.ts = p.ts AND o.symbol <> p.symbol AND {_CL.format('o.symbol')} = {_CL.format('p.symbol')}) GROUP BY 1, 2""")
def _(spark, d):
    x = core_rows(ft.base(blocked(panel(spark, d), 1))).select("symbol", "ts", "ret")
    number = F.substring("symbol", 2, 10).cast("int")
    return X.cluster_rotation(x, x.select("symbol").distinct().withColumn("cluster", F.floor(number / 5)))


_FE = ["body", "rng", "volume", "trade_count"]


def _features(spark, d):
    return S.bars(spark, d).withColumns({"body": F.col("close") - F.col("open"), "rng": F.col("high") - F.col("low")})


cte("fe", "SELECT *, close - open AS body, high - low AS rng FROM bars_4h")


@query("X15_correlation_matrix", "a b corr#", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM fe" for i, a in enumerate(_FE) for b in _FE[i + 1:]))
def _(spark, d):
    return X.correlation_pairs(_features(spark, d), _FE)


@query("X16_symbol_diversity", "mean_diversity# pairs! most_diverse#", f"""
SELECT avg(1 - least(abs(c), 1)) AS mean_diversity, count(*) AS pairs, max(1 - least(abs(c), 1)) AS most_diverse FROM (
SELECT a.symbol AS x, b.symbol AS y, corr(a.ret, b.ret) AS c FROM rp a JOIN rp b ON a.ts = b.ts AND a.symbol < b.symbol
WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL) WHERE isfinite(c)""")
def _(spark, d):
    x = core_rows(ft.base(blocked(panel(spark, d), 1)))
    c = X.symbol_correlations(x, "ret").filter(F.col("corr").isNotNull()).withColumn("s", 1.0 - F.least(F.abs("corr"), F.lit(1.0)))
    return c.agg(F.avg("s").alias("mean_diversity"), F.count("s").alias("pairs"), F.max("s").alias("most_diverse"))


# ---- factors ---------------------------------------------------------------

_CS = "sqrt(2 * nullif(hl2 + phl2, 0)) - sqrt(nullif(hl2, 0))"
cte("fx1", f"""
SELECT *, {', '.join(f'close / lag(close, {n}) OVER w - 1 AS ret_{n}' for n in (1, 4, 6, 12, 20, 24))}, lag(close, 21) OVER w / close - 1 AS ret_21_inv,
  high - low AS rng, pow((high - low) / nullif((high + low) / 2, 0), 2) AS hl2,
  {roll('avg({})', 'volume', 24, 12, False)} AS vol_ma, {roll('stddev_samp({})', 'volume', 24, 12, False)} AS vol_sd,
  {roll('max({})', 'high', 24, 12, False)} AS hi24, {roll('min({})', 'low', 24, 12, False)} AS lo24,
  {roll('avg({})', '(high - low)', 6, 3, False)} AS rng6, {roll('avg({})', '(high - low)', 12, 6, False)} AS rng12, {roll('avg({})', '(high - low)', 24, 12, False)} AS rng24
FROM (SELECT p.*, f.rate AS funding_rate FROM pn p LEFT JOIN funding_1h f ON f.symbol = p.symbol AND f.ts = p.ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
cte("fx2", f"""
SELECT *, 2 * (exp(al) - 1) / (1 + exp(al)) AS spread FROM (SELECT *, least(greatest({_CS}, -5), 5) + 0 * ({_CS}) AS al
  FROM (SELECT *, lag(hl2) OVER (PARTITION BY symbol ORDER BY ts) AS phl2 FROM fx1))""")


def _ema_gap(out, span):
    """pandas ewm(adjust=False): a gap ages the old level by position."""
    k = f"(2.0::DOUBLE / {span + 1})"
    return f"""
SELECT symbol, rn, close AS v, 1 AS g, CASE WHEN close IS NULL THEN 0 ELSE 1 END AS n FROM pn WHERE rn = 0
UNION ALL
SELECT s.symbol, s.rn, CASE WHEN s.close IS NULL THEN e.v WHEN e.v IS NULL THEN s.close
         ELSE (pow(1 - {k}, e.g) * e.v + {k} * s.close) / (pow(1 - {k}, e.g) + {k}) END,
       CASE WHEN s.close IS NULL THEN e.g + 1 ELSE 1 END, e.n + CASE WHEN s.close IS NULL THEN 0 ELSE 1 END
FROM {out} e JOIN pn s ON s.symbol = e.symbol AND s.rn = e.rn + 1"""


cte("ema24_e", _ema_gap("ema24_e", 24))
cte("ema48_e", _ema_gap("ema48_e", 48))
cte("fx3", f"""
SELECT x.*, CASE WHEN a.n >= 12 THEN a.v END AS ema_24, CASE WHEN b.n >= 24 THEN b.v END AS ema_48,
  {roll('avg({})', 'spread', 6, 3, False)} AS spread6, {roll('avg({})', 'spread', 48, 24, False)} AS spread48,
  funding_rate - lag(funding_rate, 6) OVER (PARTITION BY symbol ORDER BY ts) AS funding_d6,
  list(floor(rng24 * 1e9 + 0.5)) FILTER (WHERE rng24 IS NOT NULL) OVER {win(168)} AS rl,
  0.5 * CASE WHEN count(ret_1) OVER {win(20)} >= 20 THEN avg(ret_1) OVER {win(20)} END
  - 0.5 * CASE WHEN count(close) OVER {win(20)} >= 20 THEN (close - avg(close) OVER {win(20)}) / nullif(stddev_samp(close) OVER {win(20)}, 0) END AS mom_mr
FROM fx2 x JOIN ema24_e a USING (symbol, rn) JOIN ema48_e b USING (symbol, rn)""".replace("PARTITION BY symbol", "PARTITION BY x.symbol").replace("ORDER BY ts", "ORDER BY x.ts"))
cte("fx4", f"""
SELECT x.*, r.regime, r.br12, CASE WHEN len(rl) >= 48 AND rng24 IS NOT NULL THEN (len(list_filter(rl, lambda q: q < floor(rng24 * 1e9 + 0.5))) + (len(list_filter(rl, lambda q: q = floor(rng24 * 1e9 + 0.5))) + 1) / 2.0) / len(rl) END AS rng_rank,
  (volume - vol_ma) / nullif(vol_sd, 0) AS vz, (close - lo24) / nullif(lo24, 0) AS bd, rng6 / nullif(rng24, 0) AS ex
FROM fx3 x LEFT JOIN (SELECT ts, CASE WHEN close > ema_48 THEN 1 ELSE -1 END AS regime, ret_12 AS br12 FROM fx3 WHERE symbol = '{BENCH}') r ON r.ts = x.ts""")

# factor -> (raw SQL, how it enters the cross-section)
_SQLF = {
    "ret_1h_rank": ("ret_1", "rank"), "ret_4h_rank": ("ret_4", "rank"), "ret_12h_rank": ("ret_12", "rank"), "ret_24h_rank": ("ret_24", "rank"),
    "reversal_1h_zscore": ("ret_1", "-z"), "reversal_4h_zscore": ("ret_4", "-z"), "volume_zscore": ("vol_ma", "z"), "range_zscore": ("rng12", "z"),
    "breakout_n_high": ("(close - hi24) / nullif(hi24, 0)", "-z"), "breakdown_n_low": ("bd", "z"),
    "trend_pullback_ema": ("(close - ema_48) / nullif(rng12, 0)", "z"), "compression_expansion": ("ex", "z"),
    "funding_extreme_short": ("funding_rate", "z"), "funding_extreme_long": ("funding_rate", "-z"), "funding_momentum_fade": ("funding_d6", "fade"),
    "volume_climax_reversal_short": ("vz * CASE WHEN close > open THEN 1 ELSE 0 END * (1 + (high - greatest(open, close)) / nullif(rng, 0)) * abs(close - open) / nullif(rng, 0)", "z"),
    "volume_climax_reversal_long": ("vz * CASE WHEN close < open THEN 1 ELSE 0 END * (1 + (least(open, close) - low) / nullif(rng, 0)) * abs(close - open) / nullif(rng, 0)", "z"),
    "btc_downtrend_breakdown_short": ("-abs(bd) * sign(bd)", "z"),
    "btc_uptrend_pullback_long": ("-(close - ema_24) / nullif(ema_24, 0) * greatest(regime, 0)", "z"),
    "btc_lead_lag_alt_long": ("(br12 - ret_12) * nullif(sign(br12), 0)", "z"), "btc_lead_lag_alt_short": ("(ret_12 - br12) * nullif(sign(-br12), 0)", "z"),
    "compression_breakout_regime": ("ex * regime", "z"), "corwin_schultz_spread_proxy": ("spread", "z"),
    "spread_contraction_signal": ("CASE WHEN spread48 / nullif(spread6, 0) IS NOT NULL THEN least(greatest(spread48 / nullif(spread6, 0), 0.1), 10) END", "z"),
    "session_volatility_regime": ("1 - 4 * pow(rng_rank - 0.5, 2)", "z"),
    "alpha_momentum_21": ("ret_21_inv", "z"), "momentum_20": ("ret_20", "raw"), "momentum_mean_reversion": ("mom_mr", "raw")}


def _factor_sql(name, src="fx4"):
    raw, kind = _SQLF[name]
    z = "(x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0)"
    v = {"z": z, "-z": f"-({z})", "raw": "x", "rank": f"({rank_avg_sql('x')}) / count(x) OVER w", "fade": f"-({z}) * sign(ret_6)"}[kind]
    return f"SELECT symbol, ts, {v} AS {name} FROM (SELECT symbol, ts, ret_6, {raw} AS x FROM {src}) WINDOW w AS (PARTITION BY ts)"


def _fpanel(spark, d):
    f = T.ffill_resample(S.funding(spark, d), "1 hour")
    return T.reindex_overlay(panel(spark, d), f, "rate", "funding_rate")


def _register_factors():
    for i, name in enumerate(FA.FACTORS, 1):
        src = "fx4"
        query(f"F{i}_{name}", f"symbol ts@ {name}#", _factor_sql(name, src))(
            lambda spark, d, name=name: FA.compute_factors(_fpanel(spark, d), [name], BENCH))


_register_factors()

# ---- evaluation ----------------------------------------------------------------

_EV = ["reversal_1h_zscore", "ret_4h_rank", "range_zscore", "momentum_20"]
_DIR = {k: FA.FACTORS[k].direction for k in _EV}
_HZ = [1, 4]


def _scores(spark, d, names=None, horizons=None):
    """Factor scores in long form with forward returns."""
    names, horizons = names or _EV, horizons or _HZ
    w = E.forward_returns(FA.compute_factors(panel(spark, d), names, BENCH), horizons)
    return E.long_scores(w, names, [f"fwd_{h}" for h in horizons])


cte("fwd", "SELECT symbol, ts, lead(close, 1) OVER w / close - 1 AS fwd_1, lead(close, 4) OVER w / close - 1 AS fwd_4 FROM pn WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
cte("lscores", " UNION ALL ".join(f"SELECT s.symbol, s.ts, '{n}' AS factor, s.{n} AS score, f.fwd_1, f.fwd_4 FROM ({_factor_sql(n)}) s JOIN fwd f ON f.symbol = s.symbol AND f.ts = s.ts" for n in _EV))
cte("lranked", f"SELECT *, {rank_avg_sql('score', 'ts, factor')} AS rf, {rank_avg_sql('fwd_1', 'ts, factor')} AS r1, {rank_avg_sql('fwd_4', 'ts, factor')} AS r4x FROM lscores")


def _ic_sql(r):
    return (f"SELECT ts, factor, (avg(rf * {r}) FILTER (WHERE rf IS NOT NULL AND {r} IS NOT NULL) - avg(rf) * avg({r}) FILTER (WHERE rf IS NOT NULL) "
            f"- avg({r}) * avg(rf) FILTER (WHERE {r} IS NOT NULL) + avg(rf) * avg({r})) / nullif(stddev_pop(rf) * stddev_pop({r}), 0) AS rank_ic FROM lranked GROUP BY ts, factor")


cte("ic1", _ic_sql("r1"))
cte("ic4", _ic_sql("r4x"))


def _spread_sql(f):
    return (f"SELECT ts, factor, avg({f}) FILTER (WHERE p >= 0.8) AS top_return, avg({f}) FILTER (WHERE p <= 0.2) AS bottom_return, "
            f"avg({f}) FILTER (WHERE p >= 0.8) - avg({f}) FILTER (WHERE p <= 0.2) AS spread "
            f"FROM (SELECT *, rf / count(score) OVER (PARTITION BY ts, factor) AS p FROM lranked) GROUP BY ts, factor")


cte("sp1", _spread_sql("fwd_1"))
cte("sp4", _spread_sql("fwd_4"))
cte("turn", """
SELECT ts, factor, CASE WHEN n >= 4 AND h THEN least(1, greatest(0, 1 - o / 4.0)) END AS turnover FROM (
SELECT ts, factor, count(score) AS n, bool_or(was) AS h, count(CASE WHEN top AND was THEN 1 END) AS o FROM (
  SELECT *, coalesce(lag(top) OVER (PARTITION BY factor, symbol ORDER BY ts), false) AS was FROM (
    SELECT *, coalesce(CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY ts, factor ORDER BY score NULLS LAST, symbol) / count(score) OVER (PARTITION BY ts, factor) END > 16 / 20.0::DOUBLE, false) AS top FROM lscores))
GROUP BY ts, factor)""")


@query("flagship_reversal_ic", "n_timestamps! mean_ic# std_ic# ic_ir#", """
SELECT count(rank_ic) AS n_timestamps, avg(rank_ic) AS mean_ic, stddev_samp(rank_ic) AS std_ic, avg(rank_ic) / stddev_samp(rank_ic) AS ic_ir FROM ic1 WHERE factor = 'reversal_1h_zscore'""")
def _(spark, d):
    ic = E.rank_ic(_scores(spark, d, ["reversal_1h_zscore"], [1]), "fwd_1")
    return ic.agg(F.count("rank_ic").alias("n_timestamps"), F.avg("rank_ic").alias("mean_ic"),
                  F.stddev_samp("rank_ic").alias("std_ic"),
                  div(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("ic_ir"))


@query("E1_forward_returns", "symbol ts@ fwd_1# fwd_4#", "SELECT * FROM fwd")
def _(spark, d):
    return E.forward_returns(panel(spark, d), _HZ)


@query("E2_rank_ic", "ts@ factor rank_ic#", "SELECT * FROM ic1")
def _(spark, d):
    return E.rank_ic(_scores(spark, d), "fwd_1")


@query("E3_top_bottom_spread", "ts@ factor top_return# bottom_return# spread#", "SELECT * FROM sp1")
def _(spark, d):
    return E.top_bottom_spread(_scores(spark, d), "fwd_1", 20)


@query("E4_turnover", "ts@ factor turnover#", "SELECT * FROM turn")
def _(spark, d):
    return E.turnover(_scores(spark, d), 20)


cte("eval_raw", """
SELECT i.factor, i.horizon, avg(rank_ic) AS m, median(rank_ic) AS md, stddev_samp(rank_ic) AS sd, count(rank_ic) AS n_timestamps, sum(spread) AS gross_return
FROM (SELECT *, 1 AS horizon FROM ic1 UNION ALL SELECT *, 4 FROM ic4) i JOIN (SELECT *, 1 AS horizon FROM sp1 UNION ALL SELECT *, 4 FROM sp4) s USING (ts, factor, horizon) GROUP BY ALL""")
cte("evald", """
SELECT *, CASE WHEN n_timestamps < 50 THEN 'FAIL' WHEN mean_rank_ic > 0.02 AND ic_ir > 0.3 THEN 'PASS' WHEN mean_rank_ic < -0.02 AND ic_ir < -0.3 THEN 'FAIL'
  WHEN mean_rank_ic > 0.01 AND ic_ir > 0.15 THEN 'WATCH' WHEN abs(mean_rank_ic) < 0.005 THEN 'FAIL' ELSE 'WATCH' END AS pass_fail FROM (
SELECT factor, horizon, m * s AS mean_rank_ic, md * s AS median_rank_ic, least(100, greatest(-100, m * s / sd)) AS ic_ir, n_timestamps, gross_return, gross_return * s AS net_return, turnover
FROM (SELECT e.*, CASE WHEN factor = 'ret_4h_rank' THEN -1 ELSE 1 END AS s, t.turnover FROM eval_raw e LEFT JOIN (SELECT factor, avg(turnover) AS turnover FROM turn GROUP BY factor) t USING (factor)))""")
_EVC = "factor horizon! mean_rank_ic# median_rank_ic# ic_ir# n_timestamps! gross_return# net_return# turnover# pass_fail"


def _evaluated(spark, d):
    return E.evaluate(_scores(spark, d), _HZ, _DIR, 20)


@query("E5_evaluate_factor", _EVC, "SELECT * FROM evald")
def _(spark, d):
    return _evaluated(spark, d)


@query("E6_sign_stability", "factor positive! negative! status", """
SELECT factor, positive, negative, CASE WHEN positive + negative < 2 THEN NULL WHEN greatest(positive, negative) = positive + negative THEN 'STABLE'
  WHEN greatest(positive, negative) * 3 >= (positive + negative) * 2 THEN 'MILD' ELSE 'FLIP' END AS status FROM (
SELECT factor, count(CASE WHEN m > 0 THEN 1 END) AS positive, count(CASE WHEN m < 0 THEN 1 END) AS negative FROM (
SELECT factor, w, avg(rank_ic * CASE WHEN factor = 'ret_4h_rank' THEN -1 ELSE 1 END) AS m FROM ic1 JOIN (
  SELECT ts, least((row_number() OVER (ORDER BY ts) - 1) // (count(*) OVER () // 3), 2) AS w FROM (SELECT DISTINCT ts FROM ic1)) USING (ts) GROUP BY factor, w) GROUP BY factor)""")
def _(spark, d):
    return E.sign_stability(E.rank_ic(_scores(spark, d), "fwd_1"), _DIR)


# features of bars against the next return
_FI = ["body", "rng", "volume", "trade_count", "upper"]
cte("fi", "SELECT symbol, ts, rn, close - open AS body, high - low AS rng, volume, trade_count, high - greatest(open, close) AS upper, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS y FROM b4")
cte("fl", " UNION ALL ".join(f"SELECT '{f}' AS feature, symbol, ts, {f}::DOUBLE AS x, y FROM fi WHERE y IS NOT NULL" for f in _FI))


def _fi(spark, d):
    b = E.forward_returns(S.bars(spark, d), [1])
    return b.withColumns({"body": F.col("close") - F.col("open"), "rng": F.col("high") - F.col("low"),
                          "upper": F.col("high") - F.greatest("open", "close"), "y": F.col("fwd_1")})


cte("fic", f"""
SELECT feature, count(*) AS n_valid, corr(x, y) AS ic, abs(corr(x, y)) AS abs_ic, corr(rx, ry) AS rank_ic FROM (
SELECT *, {rank_avg_sql('x', 'feature')} AS rx, {rank_avg_sql('y', 'feature')} AS ry FROM fl) GROUP BY feature""")


@query("E7_per_feature_ic", "feature n_valid! ic# rank_ic# abs_ic#", "SELECT * FROM fic")
def _(spark, d):
    return E.per_feature_ic(_fi(spark, d), _FI, "y")


@query("E8_walk_forward_ic", "feature fold! ic#", """
SELECT feature, fold, corr(x, y) AS ic FROM fl JOIN (SELECT ts, least((row_number() OVER (ORDER BY ts) - 1) // (count(*) OVER () // 6), 5) AS fold FROM (SELECT DISTINCT ts FROM fi)) USING (ts) GROUP BY ALL""")
def _(spark, d):
    from barlens.operators.splits import equal_time_folds
    x = equal_time_folds(_fi(spark, d), 6)
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in _FI])
    lg = x.filter(F.col("y").isNotNull()).select("fold", "y", F.explode(arr).alias("_e")).select("fold", "y", "_e.feature", "_e.x")
    from barlens.functions.stats import corr_agg
    return lg.groupBy("feature", "fold").agg(corr_agg("x", "y").alias("ic"))


@query("E9_greedy_select", "feature pick!", """
SELECT unnest(chosen) AS feature, 1 AS pick FROM gpick ORDER BY i DESC LIMIT (SELECT len(chosen) FROM gpick ORDER BY i DESC LIMIT 1)""",
       gpairs=" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM fi" for i, a in enumerate(_FI) for b in _FI[i + 1:]),
       gorder="""SELECT f.feature, row_number() OVER (ORDER BY abs_ic DESC, f.feature) AS i,
 list_transform(list_filter((SELECT list({'a': p.a, 'b': p.b, 'c': p.corr}) FROM gpairs p), lambda q: abs(q.c) > 0.5 AND (q.a = f.feature OR q.b = f.feature)), lambda q: CASE WHEN q.a = f.feature THEN q.b ELSE q.a END) AS bad FROM fic f WHERE abs_ic >= 0.005""",
       gpick="""SELECT 0 AS i, CAST([] AS VARCHAR[]) AS chosen UNION ALL
SELECT g.i, CASE WHEN len(p.chosen) < 20 AND len(list_intersect(p.chosen, coalesce(g.bad, []))) = 0 THEN list_append(p.chosen, g.feature) ELSE p.chosen END FROM gpick p JOIN gorder g ON g.i = p.i + 1""")
def _(spark, d):
    x = _fi(spark, d)
    ic = E.per_feature_ic(x, _FI, "y")
    chosen = E.greedy_select(ic, X.correlation_pairs(x, _FI), corr_threshold=0.5)
    return ic.filter(F.col("feature").isin(chosen)).select("feature", F.lit(1).alias("pick"))


@query("E10_dynamic_weights", "feature weight#", """
SELECT feature, greatest(abs_ic, 0.001) / sum(greatest(abs_ic, 0.001)) OVER () AS weight FROM fic""")
def _(spark, d):
    return E.dynamic_weights(E.per_feature_ic(_fi(spark, d), _FI, "y"))


@query("E11_leaderboard", "rank! factor horizon! net_return# pass_fail", """
SELECT * FROM (SELECT row_number() OVER (ORDER BY CASE pass_fail WHEN 'PASS' THEN 0 WHEN 'WATCH' THEN 1 ELSE 2 END, net_return DESC NULLS LAST, factor, horizon) AS rank, * FROM evald) WHERE rank <= 5""")
def _(spark, d):
    return E.leaderboard(_evaluated(spark, d), 5)


@query("E15_direction_audit", "factor direction raw_mean_rank_ic# raw_ic_ir# long_bucket_return# short_bucket_return# top_bottom_raw# top_bottom_direction_adjusted# orientation_status best_orientation n_timestamps!", """
SELECT *, CASE WHEN ok THEN 'ALIGNED' ELSE 'MISALIGNED' END AS orientation_status, CASE WHEN ok THEN 'raw' ELSE 'inverted' END AS best_orientation,
       top_bottom_raw * CASE WHEN direction = 'short' THEN -1 ELSE 1 END AS top_bottom_direction_adjusted FROM (
SELECT factor, CASE factor WHEN 'ret_4h_rank' THEN 'short' ELSE 'long' END AS direction, m AS raw_mean_rank_ic, m / sd AS raw_ic_ir, n AS n_timestamps, l AS long_bucket_return, s AS short_bucket_return, d AS top_bottom_raw,
       CASE factor WHEN 'ret_4h_rank' THEN m < 0 ELSE m > 0 END AS ok
FROM (SELECT factor, avg(rank_ic) AS m, stddev_samp(rank_ic) AS sd, count(rank_ic) AS n FROM ic1 GROUP BY factor)
JOIN (SELECT factor, sum(top_return) AS l, sum(bottom_return) AS s, sum(spread) AS d FROM sp1 GROUP BY factor) USING (factor))""")
def _(spark, d):
    s = _scores(spark, d)
    return E.direction_audit(E.rank_ic(s, "fwd_1"), E.top_bottom_spread(s, "fwd_1", 20), _DIR)
