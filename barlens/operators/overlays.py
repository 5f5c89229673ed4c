"""Overlay features: funding, open interest, premium basis, multi-timeframe context (W41..W48)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barlens.functions import bars as B
from barlens.functions.core import div, ln
from barlens.operators import timegrid as T
from barlens.operators.features import base, cumulative, on_bars, rsi
from barlens.operators.windows import RN, lag, r_mean, r_std, r_zscore
from barlens.plans.ordered import blocked, core_rows, frame, running
from barlens.plans.recurrence import Ema, ema, emas, lookback_for


def funding_proxy(df: DataFrame) -> DataFrame:
    """-(close / running mean of the typical price - 1) * 100, used where no rate is known (blocked)."""
    df = cumulative(df, {"_tp": B.typical_price(), "_n": F.lit(1.0)})
    vw = div("_tp", "_n")
    return df.withColumn("funding_proxy", -(div(F.col("close"), vw) - 1.0) * 100.0).drop("_tp", "_n")


def funding_group(df: DataFrame, window: int = 10, oi_window: int = 10) -> DataFrame:
    """Level, spread, z, change of the funding rate, volume-based OI proxy and their divergence (blocked)."""
    f = F.col("funding_rate")
    raw = F.col("volume") * F.abs(div(F.col("close"), lag("close")) - 1.0)
    df = df.withColumn("_oi", raw)
    df = df.withColumns({
        "funding_rate_ma_N": r_mean(f, window), "funding_rate_vol_N": r_std(f, window), "funding_rate_zscore_N": r_zscore(f, window),
        "funding_rate_change_N": f - lag("funding_rate"),
        "open_interest_proxy_N": F.when(RN() >= oi_window, r_mean("_oi", oi_window))})
    div_ = r_zscore(f, oi_window) - r_zscore("open_interest_proxy_N", oi_window)
    return df.withColumn("funding_oi_divergence_N", div_).drop("_oi")


def open_interest_group(df: DataFrame, window: int = 10) -> DataFrame:
    """Change, volume ratio, z, percent change, and z(oi)*z(price) against the bars before (blocked)."""
    oi, c, v = F.col("open_interest"), F.col("close"), F.col("volume")
    p = lag("open_interest")
    df = df.withColumns({"_oc": (div(oi, p) - 1.0) * 100.0, "_rc": (div(c, lag("close")) - 1.0) * 100.0})
    past = frame(start=-window, end=-1)

    def z(x):
        sd = F.greatest(F.stddev_pop(x).over(past), F.lit(1e-12))
        return F.when(F.count(x).over(past) >= 3, (F.col(x) - F.avg(x).over(past)) / sd)

    om, vm = r_mean(oi, window), r_mean(v, window)
    return df.withColumns({
        "open_interest_change_N": oi - p, "open_interest_volume_ratio": div(om, vm), "open_interest_zscore_N": r_zscore(oi, window),
        "open_interest_change_pct_N": F.col("_oc"),
        "oi_price_divergence_N": F.when(RN() >= window, z("_oc") * z("_rc"))}).drop("_oc", "_rc")


def basis_group(df: DataFrame, window: int = 10, threshold: float = 2.0) -> DataFrame:
    b = F.col("basis")
    return df.withColumns({"basis_ma_N": r_mean(b, window), "basis_vol_N": r_std(b, window), "basis_zscore_N": r_zscore(b, window),
                           "basis_regime_N": B.basis_regime(b, threshold)})


def context_features(blocks: DataFrame) -> DataFrame:
    """Slope, strength, band position, RSI, ATR regime, volatility expansion and volume ratio of k-bar blocks."""
    look = lookback_for(2.0 / 51) + lookback_for(2.0 / 15)
    x = blocks.select("symbol", "block", F.col("ts").alias("ts"), "open", "high", "low", "close", "volume")
    b = base(blocked(x, look))
    d = F.col("close") - lag("close")
    b = b.withColumns({"_g": F.when(d > 0, d).when(d.isNotNull(), 0.0), "_l": F.when(d < 0, -d).when(d.isNotNull(), 0.0)})
    b = emas(b, *[Ema("close", 2.0 / (n + 1), f"_e{n}") for n in (5, 20)], Ema("tr", 2.0 / 15, "_atr"), Ema("volume", 2.0 / 21, "_vm"),
             Ema("_g", 1.0 / 14, "_ag", seed="sma", n=14), Ema("_l", 1.0 / 14, "_al", seed="sma", n=14))
    b = ema(b, "_atr", 2.0 / 51, "_atrm")
    sd = r_std("close", 20, 20)
    width = 4.0 * sd
    vs, vl = r_std("ret", 5, 5), r_std("ret", 20, 20)
    b = b.withColumns({
        "ema_slope": F.col("_e5") - lag("_e5"),
        "trend_strength": (F.col("_e5") - F.col("_e20")) / F.greatest(F.col("close"), F.lit(1e-10)),
        "bb_position": F.when(width > 1e-10, div(F.col("close") - (F.col("_e20") - 2.0 * sd), width)),
        "rsi": 100.0 - 100.0 / (1.0 + F.col("_ag") / F.greatest(F.col("_al"), F.lit(1e-10))),
        "atr_regime": F.when(F.col("_atrm") > 1e-10, div("_atr", "_atrm")),
        "vol_expansion": F.when(vl > 1e-10, div(vs, vl)), "volume_ratio": F.when(F.col("_vm") > 1e-10, div("volume", "_vm"))})
    return core_rows(b).select("symbol", "block", *CONTEXT)


CONTEXT = ["ema_slope", "trend_strength", "bb_position", "rsi", "atr_regime", "vol_expansion", "volume_ratio"]


def mtf_context(bars: DataFrame, k: int) -> DataFrame:
    """Features of k-bar blocks on the bars, each from the bar its block is finished at."""
    ctx = context_features(T.resample_bars_by_count(bars, k))
    return T.stretch_context(bars, ctx, k, CONTEXT)


def local_context(bars: DataFrame, k: int = 4) -> DataFrame:
    """Range, volatility and momentum of finished blocks of k bars."""
    p = T.resample_bars_by_count(bars, k).filter(F.col("n_bars") == k)
    from barlens.plans.ordered import with_position
    first = with_position(bars).withColumn("block", F.floor(F.col("rn") / k)).groupBy("symbol", "block").agg(F.min_by("close", "ts").alias("_c0"))
    x = p.join(first, ["symbol", "block"])
    c0 = F.greatest(F.col("_c0"), F.lit(1e-10))
    ctx = x.select("symbol", "block", (F.col("high") - F.col("low")).alias("local_range"),
                   ((F.col("high") - F.col("low")) / c0).alias("local_volatility"), ((F.col("close") - F.col("_c0")) / c0).alias("local_momentum"))
    return T.stretch_context(bars, ctx, k, ["local_range", "local_volatility", "local_momentum"], partial=False)


def funding_regime(df: DataFrame, window: int = 168, span: int = 168, as_of: str = "expanding") -> DataFrame:
    """z against the ``window`` bars before, direction, and a regime by the smoothed size of the rate.

    The regime compares with the mean smoothed size: of the past only
    ('expanding'), or of the whole series ('full', which looks ahead).
    """
    b = blocked(df, max(window, lookback_for(2.0 / (span + 1))))
    past = frame(start=-window, end=-1)
    f = F.col("funding_rate")
    sd = F.stddev_pop(f).over(past)
    b = b.withColumn("funding_zscore", F.when((RN() >= window) & (sd > 1e-10), div(f - F.avg(f).over(past), sd)))
    b = ema(b.withColumn("_a", F.abs(f)), "_a", 2.0 / (span + 1), "_m").drop("_a")
    if as_of == "full":
        x = core_rows(b)
        g = x.groupBy("symbol").agg(F.avg("_m").alias("_t"))
        x = x.join(g, "symbol")
    else:
        x = running(b.filter("core"), ["symbol"], ["rn"], {"_s": ("sum", F.col("_m")), "_n": ("count", F.col("_m"))}, slice_col=F.col("blk"))
        x = x.withColumn("_t", div("_s", "_n")).drop("_s", "_n", "blk", "core", "zone", "rn")
    m, t = F.col("_m"), F.col("_t")
    return x.withColumns({"funding_direction": F.signum(f),
                          "funding_regime": F.when(t > 0, F.when(m > t * 1.5, 2.0).when(m < t * 0.5, 0.0).when(m.isNotNull(), 1.0))}).drop("_m", "_t")


__all__ = [k for k in list(globals()) if not k.startswith("_")] + ["Window", "ln", "on_bars"]
