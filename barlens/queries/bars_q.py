"""Queries: per-bar expressions (P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions import bars as B
from barlens.functions.core import div, ln
from barlens.operators import features as ft
from barlens.operators.windows import RN, lag
from barlens.queries.registry import cte, query
from barlens.sources import tables as S

# bars with the shared per-bar columns
cte("r4", """
SELECT *, ln(close / pc) AS ret, CASE WHEN rn = 0 THEN high - low
       ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
       CASE WHEN close > open THEN volume WHEN close < open THEN 0 ELSE volume * 0.5 END AS up,
       CASE WHEN close < open THEN volume WHEN close > open THEN 0 ELSE volume * 0.5 END AS dn,
       (high + low) * 0.5 AS mid, (high + low + close) / 3.0 AS tp
FROM (SELECT *, lag(close) OVER w AS pc, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl
      FROM b4 WINDOW w AS (PARTITION BY symbol ORDER BY ts))""")


@query("P1_log_return", "symbol ts@ r1# r10#", """
SELECT symbol, ts, ret AS r1, ln(close / lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts)) AS r10 FROM r4""")
def _(spark, d):
    return ft.on_bars(S.bars(spark, d), 10, lambda x: x.withColumns({
        "r1": ln(div("close", lag("close"))), "r10": ln(div("close", lag("close", 10)))}))


@query("P2_momentum_roc", "symbol ts@ momentum_N# roc_N# simple_return_N#", """
SELECT symbol, ts, close - p AS "momentum_N", (close / p - 1) * 100 AS "roc_N", close / p - 1 AS "simple_return_N"
FROM (SELECT *, lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM b4)""")
def _(spark, d):
    return ft.on_bars(S.bars(spark, d), 10, ft.momentum_basic)


@query("P3_true_range", "symbol ts@ tr#", "SELECT symbol, ts, tr FROM r4")
def _(spark, d):
    return ft.on_bars(S.bars(spark, d), 1, ft.base)


@query("P4_candle_geometry", "symbol ts@ body# upper# lower#", """
SELECT symbol, ts, abs(close - open) / nullif(high - low, 0) AS body,
       (high - greatest(open, close)) / nullif(high - low, 0) AS upper,
       (least(open, close) - low) / nullif(high - low, 0) AS lower FROM bars_4h""")
def _(spark, d):
    return S.bars(spark, d).withColumns({"body": B.body_ratio(), "upper": B.upper_wick_ratio(),
                                         "lower": B.lower_wick_ratio()})


@query("P5_typical_price_dollar_volume", "symbol ts@ tp# dv#", """
SELECT symbol, ts, (high + low + close) / 3.0 AS tp, close * volume AS dv FROM bars_4h""")
def _(spark, d):
    return S.bars(spark, d).withColumns({"tp": B.typical_price(), "dv": B.dollar_volume()})


@query("P6_classify_volume", "symbol ts@ up# dn#", "SELECT symbol, ts, up, dn FROM r4")
def _(spark, d):
    return S.bars(spark, d).withColumns({"up": B.up_volume(), "dn": B.down_volume()})


@query("P7_taker_buy_proxy", "symbol ts@ real# proxy#", """
SELECT symbol, ts, taker_buy_volume AS real,
       least(greatest(volume * (close - low) / CASE WHEN high > low THEN high - low ELSE 1e-10 END, 0), volume) AS proxy
FROM bars_4h""")
def _(spark, d):
    return S.bars(spark, d).withColumns({"real": B.taker_buy(F.col("taker_buy_volume")), "proxy": B.taker_buy()})


@query("P8_candle_patterns", "symbol ts@ doji? marubozu? engulfing? hammer? gap?", """
SELECT symbol, ts, coalesce(body <= 0.1 * nullif(rng, 0), false) AS doji,
       coalesce(((up + dnw) / nullif(rng, 0)) * 2.0 <= 0.2, false) AS marubozu,
       coalesce((pc < po AND close > open AND open < pc AND close > po)
             OR (pc > po AND close < open AND open > pc AND close < po), false) AS engulfing,
       rng > 0 AND body > 0 AND ((dnw >= 2 * body AND up <= 0.3 * body) OR (up >= 2 * body AND dnw <= 0.3 * body)) AS hammer,
       coalesce(open > pc * 1.001 OR open < pc * 0.999, false) AS gap
FROM (SELECT * EXCLUDE (up, dn), abs(close - open) AS body, high - low AS rng, high - greatest(open, close) AS up,
             least(open, close) - low AS dnw FROM r4)""")
def _(spark, d):
    return ft.on_bars(S.bars(spark, d), 1, lambda x: x.withColumns({
        "doji": B.is_doji(), "marubozu": B.is_marubozu(), "engulfing": B.is_engulfing(lag("open"), lag("close")),
        "hammer": B.is_hammer(), "gap": B.is_gap(lag("close"))}))


@query("P9_calendar", "symbol ts@ hour_of_day_sin# hour_of_day_cos# day_of_week_sin# day_of_week_cos# is_us_hours#", """
SELECT symbol, ts, sin(2 * pi() * hour(ts) / 24) AS hour_of_day_sin, cos(2 * pi() * hour(ts) / 24) AS hour_of_day_cos,
       sin(2 * pi() * (isodow(ts) - 1) / 7) AS day_of_week_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS day_of_week_cos,
       CASE WHEN hour(ts) >= 14 AND hour(ts) < 20 THEN 1.0 ELSE 0.0 END AS is_us_hours
FROM bars_1h""")
def _(spark, d):
    return S.bars(spark, d, "1 hour").withColumns(B.calendar(F.col("ts")))


@query("P10_session_label", "symbol ts@ session liquidity#", """
SELECT symbol, ts, CASE WHEN h < 7 THEN 'ASIA' WHEN h < 12 THEN 'LONDON' WHEN h < 16 THEN 'LONDON_NEW_YORK_OVERLAP'
       WHEN h < 21 THEN 'NEW_YORK' ELSE 'OFF_HOURS' END AS session,
       CASE WHEN h < 7 THEN 0.65 WHEN h < 12 THEN 0.9 WHEN h < 16 THEN 1.0 WHEN h < 21 THEN 0.95 ELSE 0.5 END AS liquidity
FROM (SELECT symbol, ts, hour(ts) AS h FROM bars_1h)""")
def _(spark, d):
    label, score = B.session_label(F.col("ts"))
    return S.bars(spark, d, "1 hour").withColumns({"session": label, "liquidity": score})


@query("P11_basis", "symbol ts@ basis_bps# basis_regime#", """
SELECT symbol, ts, b AS basis_bps, CASE WHEN b > 200 THEN 1.0 WHEN b < -200 THEN -1.0 WHEN b IS NOT NULL THEN 0.0 END AS basis_regime
FROM (SELECT p.symbol, p.ts, ((b.close + p.value) / nullif(b.close, 0) - 1) * 10000 AS b
      FROM premium p JOIN bars_1h b ON p.symbol = b.symbol AND p.ts = b.ts)""")
def _(spark, d):
    j = S.premium_index(spark, d).join(S.bars(spark, d, "1 hour").select("symbol", "ts", "close"), ["symbol", "ts"])
    j = j.withColumn("basis_bps", B.basis_bps(F.col("close") + F.col("value"), F.col("close")))
    return j.withColumn("basis_regime", B.basis_regime(F.col("basis_bps"), 200.0))


@query("P12_obi", "symbol ts@ obi#", """
SELECT symbol, ts, CASE WHEN up + dn > 0 THEN (up - dn) / (up + dn) ELSE 0 END AS obi FROM r4""")
def _(spark, d):
    return S.bars(spark, d).withColumn("obi", B.obi())


@query("P13_corwin_schultz", "symbol ts@ spread#", """
SELECT symbol, ts, CASE WHEN a > 0 THEN 2 * (exp(a) - 1) / (1 + exp(a)) END AS spread FROM (
  SELECT symbol, ts, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0::DOUBLE)) - sqrt(gamma / (3 - 2 * sqrt(2.0::DOUBLE))) AS a
  FROM (SELECT symbol, ts, pow(ln(ph / pl), 2) + pow(ln(high / low), 2) AS beta,
               pow(ln(greatest(ph, high) / least(pl, low)), 2) AS gamma FROM r4 WHERE ph IS NOT NULL))
UNION ALL SELECT symbol, ts, NULL FROM r4 WHERE ph IS NULL""")
def _(spark, d):
    return ft.on_bars(S.bars(spark, d), 1, lambda x: x.withColumn("spread", B.corwin_schultz(lag("high"), lag("low"))))


@query("P14_parkinson_spread", "symbol ts@ spread#", """
SELECT symbol, ts, sqrt((high - low) * (high - low) / (4 * ln(2.0::DOUBLE))) AS spread FROM bars_4h""")
def _(spark, d):
    return S.bars(spark, d).withColumn("spread", B.parkinson_spread())
