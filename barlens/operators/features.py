"""Price, volatility, momentum and volume features on a blocked bar table.

Every group takes and returns a table with ``rn`` and ``blk`` (see
``plans.ordered.blocked``) and adds columns.  ``on_bars`` lays out plain bars,
runs the groups in one layout and gives the plain rows back, so any number of
groups costs one shuffle by (symbol, block).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.functions import bars as B
from barlens.functions.core import clip, div, ln
from barlens.operators.windows import (RN, lag, r_beta, r_corr, r_list, r_max, r_mean, r_median, r_min,
                                       r_slope, r_std, r_sum, r_var, r_zscore, roll)
from barlens.plans.order_stats import Moving, moving
from barlens.plans.ordered import blocked, core_rows, frame, running
from barlens.plans.recurrence import Ema, ema, emas, lookback_for

O, H, L, C, V = B.O, B.H, B.L, B.C, B.V
Group = Callable[[DataFrame], DataFrame]


def on_bars(bars: DataFrame, lookback: int, *groups: Group, lookahead: int = 0,
            rows_per_block: int | None = None) -> DataFrame:
    df = blocked(bars, lookback, lookahead, rows_per_block=rows_per_block)
    for g in groups:
        df = g(df)
    return core_rows(df)


def base(df: DataFrame) -> DataFrame:
    """Columns most groups share; added once so windows are not repeated."""
    have = set(df.columns)
    new = {}
    if "ret" not in have:
        new["ret"] = ln(div(C(), lag(C())))
    if "tr" not in have:
        pc = lag(C())
        new["tr"] = F.greatest(H() - L(), F.abs(H() - pc), F.abs(L() - pc))
    if "up_vol" not in have:
        new["up_vol"], new["dn_vol"] = B.up_volume(), B.down_volume()
    return df.withColumns(new) if new else df


# ---- returns and volatility -------------------------------------------------

def returns_group(df: DataFrame, n: int = 10, window: int = 20) -> DataFrame:
    df = base(df)
    m, sd = r_mean("ret", window), r_std("ret", window)
    thr = F.when(F.abs(m) > 1e-12, F.abs(m) * 1e-6).otherwise(1e-10)
    z = F.when(F.col("ret").isNotNull() & m.isNotNull() & sd.isNotNull(),
               F.when(sd > thr, div(F.col("ret") - m, sd)).otherwise(0.0))
    return df.withColumns({
        "log_return_1": F.col("ret"), "log_return_N": ln(div(C(), lag(C(), n))),
        "return_volatility_N": sd, "return_zscore_N": z})


def realized_vol(df: DataFrame, window: int = 20, per_year: float = 2190) -> DataFrame:
    v = r_std("ret", window) * math.sqrt(per_year)
    return base(df).withColumn("realized_vol", F.when(RN() >= window, v))


def volatility_group(df: DataFrame, window: int = 20) -> DataFrame:
    gk = 0.5 * F.pow(ln(div(H(), L())), 2) - (2.0 * math.log(2.0) - 1.0) * F.pow(ln(div(C(), O())), 2)
    df = df.withColumns({"_hl2": F.pow(ln(div(H(), L())), 2), "_gk": gk})
    g = r_mean("_gk", window)
    p = r_mean("_hl2", window)
    return df.withColumns({
        "high_low_range_N": r_mean(div(H() - L(), C()), window),
        "garman_klass_vol_N": F.when(g < 0, 0.0).otherwise(F.sqrt(F.when(g >= 0, g))),
        "parkinson_vol_N": F.when(p > 0, F.sqrt(p / (4.0 * math.log(2.0))))}).drop("_hl2", "_gk")


def parkinson_rolling(df: DataFrame, n: int = 20) -> DataFrame:
    """Fixed divisor: bars without positive prices count as zero range."""
    hl = F.when((H() > 0) & (L() > 0), F.pow(ln(div(H(), L())), 2)).otherwise(0.0)
    return df.withColumn("rolling_parkinson", F.sqrt(r_mean(hl, n, 1) / (4.0 * math.log(2.0))))


def atr_group(df: DataFrame, window: int = 14) -> DataFrame:
    df = base(df).withColumn("atr_N", r_mean("tr", window))
    a = F.col("atr_N")
    return df.withColumns({"atr_pct_N": div(a, C()) * 100.0, "atr_expansion_N": div(a, r_mean("atr_N", window))})


def atr_wilder(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean of the first n true ranges, then (p*(n-1)+tr)/n; bar 0 has no range."""
    tr = F.when(RN() > 0, F.col("tr"))
    return ema(base(df), tr, 1.0 / n, "atr_wilder", seed="sma", n=n)


# ---- momentum -------------------------------------------------------------

def momentum_basic(df: DataFrame, n: int = 10) -> DataFrame:
    p = lag(C(), n)
    return df.withColumns({"momentum_N": C() - p, "roc_N": (div(C(), p) - 1.0) * 100.0,
                           "simple_return_N": div(C(), p) - 1.0})


def rsi(df: DataFrame, n: int = 14, out: str = "rsi_N") -> DataFrame:
    d = C() - lag(C())
    df = df.withColumns({"_g": F.when(d > 0, d).when(d.isNotNull(), 0.0),
                         "_l": F.when(d < 0, -d).when(d.isNotNull(), 0.0)})
    df = emas(df, *[Ema(x, 1.0 / n, out_, seed="sma", n=n) for x, out_ in (("_g", "_ag"), ("_l", "_al"))])
    ag, al = F.col("_ag"), F.col("_al")
    return df.withColumn(out, F.when(al == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + div(ag, al)))) \
        .drop("_g", "_l", "_ag", "_al")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """EMAs seeded by the mean of their first values."""
    df = emas(df, Ema(C(), 2.0 / (fast + 1), "_f", seed="sma", n=fast), Ema(C(), 2.0 / (slow + 1), "_s", seed="sma", n=slow))
    df = df.withColumn("macd", F.col("_f") - F.col("_s"))
    df = ema(df, "macd", 2.0 / (signal + 1), "macd_signal", seed="sma", n=signal)
    return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_f", "_s")


def momentum_group(df: DataFrame, n=10, rsi_window=14, fast=12, slow=26, signal=9) -> DataFrame:
    df = df.withColumn("momentum_N", C() - lag(C(), n))
    return macd(rsi(df, rsi_window), fast, slow, signal)


def momentum_lookback(rsi_window=14, fast=12, slow=26, signal=9, **_) -> int:
    return max(lookback_for(1.0 / rsi_window) + 1,
               lookback_for(2.0 / (slow + 1)) + lookback_for(2.0 / (signal + 1)))


# ---- volume -----------------------------------------------------------------

def volume_ratio_group(df: DataFrame, window: int = 20) -> DataFrame:
    return df.withColumns({"volume_ratio_N": div(V(), r_mean(V(), window)),
                           "volume_trend_N": r_slope(F.coalesce(V(), F.lit(0.0)), window)})


def volume_zscore_spike(df: DataFrame, window: int = 24) -> DataFrame:
    return df.withColumn("volume_zscore_spike", late_z(V(), window))


def late_z(x, window: int) -> Column:
    """Population z of the last value; needs > 5 values, movement and rn >= window."""
    w = frame(window)
    sd = F.stddev_pop(x).over(w)
    return F.when((RN() >= window) & (F.count(x).over(w) > 5) & (sd > 1e-10), div(x - F.avg(x).over(w), sd))


def cumulative(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Running sums from the start of each symbol on the core rows of a blocked table.

    Keeps the blocks as ordered slices, so the long prefix never sits in one task.
    """
    return running(df.filter("core"), ["symbol"], ["rn"],
                   {k: ("sum", v) for k, v in sums.items()}, slice_col=F.col("blk"))


def volume_cumulative(df: DataFrame) -> DataFrame:
    """VWAP deviation and on-balance volume (bar 0 is 0)."""
    d = C() - lag(C())
    df = df.withColumn("_sv", F.when(d > 0, V()).when(d < 0, -V()).otherwise(0.0))
    df = cumulative(df, {"_pv": B.typical_price() * V(), "_v": V(), "obv_N": F.col("_sv")})
    vwap = div(F.col("_pv"), F.col("_v"))
    return df.withColumns({"vwap_cum": vwap, "vwap_deviation": div(C() - vwap, vwap)}).drop("_sv", "_pv", "_v")


def prefix_columns(bars: DataFrame, rows_per_block: int | None = None) -> DataFrame:
    """Bars with ``rn`` and everything that accumulates from the start of a symbol.

    One prefix scan for VWAP, on-balance volume and the runs of up and down
    bars; done before the windowed groups, so that their plan is not repeated
    for the carried totals.
    """
    d = C() - lag(C())
    b = blocked(bars, 1, rows_per_block=rows_per_block).withColumn("_sv", F.when(d > 0, V()).when(d < 0, -V()).otherwise(0.0))
    rn = F.col("rn")
    b = running(b.filter("core"), ["symbol"], ["rn"], {
        "_pv": ("sum", B.typical_price() * V()), "_v": ("sum", V()), "obv_N": ("sum", F.col("_sv")),
        "_bu": ("max", F.when(~F.coalesce(C() > O(), F.lit(False)) | (rn == 0), rn)),
        "_bd": ("max", F.when(~F.coalesce(C() < O(), F.lit(False)) | (rn == 0), rn))}, slice_col=F.col("blk"))
    vwap = div(F.col("_pv"), F.col("_v"))
    return b.withColumns({"vwap_cum": vwap, "vwap_deviation": div(C() - vwap, vwap),
                          "consecutive_up_N": (rn - F.col("_bu")).cast("double"), "consecutive_dn_N": (rn - F.col("_bd")).cast("double")}) \
        .drop("_sv", "_pv", "_v", "_bu", "_bd", "blk", "core", "zone")


def vwap_rolling(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn("vwap_rolling", div(r_sum(B.typical_price() * V(), n), r_sum(V(), n)))


# ---- breakout ---------------------------------------------------------------

def bollinger(df: DataFrame, window: int = 20, k: float = 2.0) -> DataFrame:
    m, sd = r_mean(C(), window), r_std(C(), window)
    df = df.withColumns({"bb_middle": m, "bb_upper": m + k * sd, "bb_lower": m - k * sd})
    u, lo = F.col("bb_upper"), F.col("bb_lower")
    return df.withColumns({"bb_position": div(C() - lo, u - lo), "bb_width": div(u - lo, "bb_middle")})


def range_breakout(df: DataFrame, window: int = 20) -> DataFrame:
    df = df.withColumns({"highest_N": r_max(H(), window), "lowest_N": r_min(L(), window)})
    hi, lo = F.col("highest_N"), F.col("lowest_N")
    return df.withColumn("range_breakout_N", div(C() - lo, hi - lo))


# ---- trend --------------------------------------------------------------------

def trend_group(df: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    df = df.withColumns({"_ms": r_mean(C(), short, short), "_ml": r_mean(C(), long, long)})
    out = {}
    for name, col, n in (("trend_ma_short_slope", "_ms", short), ("trend_ma_long_slope", "_ml", long)):
        w = max(n // 2, 5)
        out[name] = F.when(RN() >= w + n - 1, r_slope(col, w))
    out["trend_ma_cross"] = (div("_ms", "_ml") - 1.0) * 100.0
    out["trend_position"] = (div(C(), "_ml") - 1.0) * 100.0
    return df.withColumns(out).drop("_ms", "_ml")


# ---- candle patterns ------------------------------------------------------------

def candle_group(df: DataFrame, window: int = 10) -> DataFrame:
    """Share of recent bars showing each pattern."""
    po, pc = lag(O()), lag(C())
    df = df.withColumns({"_doji": B.is_doji(), "_maru": B.is_marubozu(), "_eng": B.is_engulfing(po, pc),
                         "_ham": B.is_hammer(), "_gap": B.is_gap(pc)})
    from barlens.operators.windows import r_fraction
    return df.withColumns({
        "doji_N": r_fraction(F.col("_doji"), window), "marubozu_N": r_fraction(F.col("_maru"), window),
        "engulfing_N": r_fraction(F.col("_eng"), window), "hammer_N": r_fraction(F.col("_ham"), window),
        "gap_N": r_fraction(F.col("_gap"), window)}).drop("_doji", "_maru", "_eng", "_ham", "_gap")


def streaks(df: DataFrame) -> DataFrame:
    """Length of the current run of up / down bars; bar 0 never counts.

    The run may be longer than a block, so the last breaking row is a prefix maximum.
    """
    rn = F.col("rn")
    df = running(df.filter("core"), ["symbol"], ["rn"], {
        "_bu": ("max", F.when(~F.coalesce(C() > O(), F.lit(False)) | (rn == 0), rn)),
        "_bd": ("max", F.when(~F.coalesce(C() < O(), F.lit(False)) | (rn == 0), rn))}, slice_col=F.col("blk"))
    return df.withColumns({"consecutive_up_N": (rn - F.col("_bu")).cast("double"),
                           "consecutive_dn_N": (rn - F.col("_bd")).cast("double")}).drop("_bu", "_bd")


# ---- taker flow -----------------------------------------------------------------

def taker_flow_group(df: DataFrame, real: str | None = None, cvd_window=24, div_window=48, imb_window=24,
                     spike_window=24) -> DataFrame:
    tb = B.taker_buy(F.col(real) if real else None)
    df = df.withColumn("_tb", tb)
    df = df.withColumns({"taker_buy_ratio": F.when(V() > 0, div("_tb", V())),
                         "_delta": F.col("_tb") - (V() - F.col("_tb"))})
    # reset every cvd_window bars; a block edge may cut a reset group, the copied rows complete it
    grp = F.floor(RN() / F.lit(cvd_window))
    wr = Window.partitionBy("symbol", "blk", "_grp").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_grp", grp).withColumn("cvd", F.sum("_delta").over(wr))
    cz, pz = late_z(F.col("cvd"), div_window), late_z(C(), div_window)
    return df.withColumns({
        "taker_sell_ratio": 1.0 - F.col("taker_buy_ratio"),
        "cvd_divergence": cz - pz, "taker_imbalance_zscore": late_z(F.col("taker_buy_ratio"), imb_window),
        "price_velocity_5bar": div(C(), lag(C(), 5)) - 1.0, "price_velocity_10bar": div(C(), lag(C(), 10)) - 1.0,
        "volume_zscore_spike": late_z(V(), spike_window)}).drop("_tb", "_delta", "_grp")


# ---- short-horizon momentum ------------------------------------------------------

def scalp_momentum_group(df: DataFrame, n: int = 12, w: int = 6) -> DataFrame:
    df = base(df)
    r, rng = F.col("ret"), H() - L()
    sd = r_std("ret", n, n)
    rmed, vmed = r_median(rng, n), r_median(V(), n)
    late = RN() >= n
    drawup = F.abs(div(C(), r_max(C(), n)) - 1.0)
    return df.withColumns({
        "mom_quality": F.when(late, F.when(F.abs(sd) > 1e-10, div(F.abs(r), sd)).otherwise(0.0)),
        "mom_acceleration": r - lag("ret"),
        "mom_consistency": F.when(RN() >= n - 1, F.count(F.when(r > 0, 1)).over(frame(n)) / float(n)),
        "mom_range_expansion": F.when(late, F.when(rmed > 1e-10, div(rng, rmed)).otherwise(1.0)),
        "mom_micro_trend": r_mean("ret", w, w) - r_mean("ret", n, n),
        "mom_volume_surge": F.when(late, F.when(vmed > 1e-10, div(V(), vmed)).otherwise(1.0)),
        "mom_divergence": F.when(RN() >= n - 1, F.when(r > 0, drawup).when(r < 0, -drawup).otherwise(0.0))})


def extended_alpha_group(df: DataFrame) -> DataFrame:
    """All windows end one bar before the current one."""
    rng = H() - L() + 1e-10
    df = df.withColumn("_rng", rng)
    past_r, past_v = r_list("_rng", start=-20, end=-1), r_list(V(), start=-20, end=-1)

    def pct(past, x):
        return F.when((RN() >= 20) & (F.size(past) > 0),
                      F.size(F.filter(past, lambda q: q < x)) / F.size(past) * 100.0)

    w12 = frame(start=-12, end=-1)
    pos_v = F.when(V() > 0, V())
    vmed = F.coalesce(F.percentile(pos_v, F.lit(0.5)).over(w12), F.lit(1.0))
    pm = F.when((RN() >= 12) & (lag(C(), 12) > 0), div(C(), lag(C(), 12)) - 1.0).otherwise(0.0)
    vm = F.when((RN() >= 12) & (vmed > 0), div(V(), vmed) - 1.0).otherwise(0.0)
    df = df.withColumns({"vol_price_ratio": div(V(), "_rng"), "range_percentile": pct(past_r, F.col("_rng")),
                         "volume_percentile": pct(past_v, V()), "price_momentum_12h": pm, "volume_momentum_12h": vm})

    def trend(n):
        m = F.when(RN() >= n, F.avg(C()).over(frame(start=-n, end=-1)))
        return F.when(m > 0, div(C(), m) - 1.0).otherwise(0.0)

    df = df.withColumns({"momentum_divergence": F.col("price_momentum_12h") - F.col("volume_momentum_12h"),
                         "trend_4h": trend(48), "trend_1d": trend(192)})
    return df.withColumn("trend_alignment", F.signum("trend_4h") * F.signum("trend_1d")).drop("_rng")


# ---- regime ------------------------------------------------------------------------

def classify_regime(df: DataFrame, sma: int = 50, atr: int = 14, slope: int = 10, quiet: float = 0.02) -> DataFrame:
    df = base(df)
    m = r_mean(C(), sma, sma)
    a = F.when(RN() >= atr, r_mean(F.when(RN() > 0, F.col("tr")), atr, atr))
    df = df.withColumns({"sma_50": m, "atr_pct": F.when(C() > 0, div(a, C())), "slope": r_slope(C(), slope)})
    m, ap, s = F.col("sma_50"), F.col("atr_pct"), F.col("slope")
    known = m.isNotNull() & s.isNotNull()
    up, down = known & (C() > m) & (s > 0), known & (C() < m) & (s < 0)
    flat = known & (ap < quiet)
    strength = F.least(F.lit(1.0), div(F.abs(s) * 1000.0, C()))
    return df.withColumns({
        "regime": F.when(up, "TREND_UP").when(down, "TREND_DOWN").when(flat, "RANGE").otherwise("TRANSITION"),
        "confidence": F.when(~known, 0.0).when(up | down, strength)
        .when(flat, F.greatest(F.lit(0.3), 1.0 - ap / quiet)).otherwise(0.5)})


def volatility_regime(df: DataFrame, window: int = 20, lo: float = 33.0, hi: float = 67.0) -> DataFrame:
    """0 quiet, 1 normal, 2 wild: |return| against order statistics of its window."""
    df = base(df)
    df = df.withColumns({"_size": F.coalesce(F.abs("ret"), F.lit(0.0)), "_enough": F.count("ret").over(frame(window)) >= 5})
    places = {k: max(0, min(window - 1, math.ceil(p / 100.0 * window) - 1)) for k, p in (("_low", lo), ("_high", hi))}
    df = moving(df, *[Moving(k, "_size", "place", window, p, full=False) for k, p in places.items()])
    a, low, high = F.abs("ret"), *(F.when(F.col("_enough"), F.col(k)) for k in places)
    v = F.when(a <= low, 0.0).when(a >= high, 2.0).otherwise(1.0)
    return df.withColumn("volatility_regime", F.when(RN() >= window, v)).drop("_size", "_enough", *places)


# ---- cross-check helpers used by queries -------------------------------------------

def rolling_stats(df: DataFrame, n: int = 20, x: str = "close") -> DataFrame:
    return df.withColumns({"r_mean": r_mean(x, n), "r_sum": r_sum(x, n), "r_std": r_std(x, n),
                           "r_var": r_var(x, n), "r_max": r_max(x, n), "r_min": r_min(x, n),
                           "r_stdp": r_std(x, n, ddof=0)})


__all__ = [k for k in list(globals()) if not k.startswith("_")]
