"""Order-flow and liquidity features estimated from bars (blocked table)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from barlens.functions import bars as B
from barlens.functions.core import clip, div, ln
from barlens.operators.features import base
from barlens.operators.windows import RN, lag, r_mean, r_std, r_sum, w_corr, w_slope, when_ready
from barlens.plans.ordered import frame

O, H, L, C, V = B.O, B.H, B.L, B.C, B.V
def UP() -> Column:
    return F.col("up_vol")


def DN() -> Column:
    return F.col("dn_vol")


def spread_group(df: DataFrame, window: int = 10) -> DataFrame:
    mid = (H() + L()) * 0.5
    return df.withColumns({
        "spread_pct_N": r_mean(F.when(C() > 0, div(H() - L(), C())), window),
        "quoted_spread_N": r_mean(F.when(mid > 0, div(2.0 * F.abs(C() - mid), mid)), window)})


def imbalance_group(df: DataFrame, window: int = 10, vpin_window: int = 50, ofi_window: int = 10,
                    depth_window: int = 5) -> DataFrame:
    df = base(df).withColumn("obi", B.obi())
    up, dn = r_sum(UP(), window), r_sum(DN(), window)
    tot = r_sum(UP() + DN(), vpin_window)
    toxic = r_sum(F.abs(UP() - DN()), vpin_window)
    return df.withColumns({
        "volume_imbalance_N": F.when(RN() >= window - 1, F.when(up + dn > 0, div(up - dn, up + dn)).otherwise(0.0)),
        "vpin_N": F.when(RN() >= vpin_window - 1, F.when(tot > 0, div(toxic, tot)).otherwise(0.0)),
        "ofi_N": r_mean("obi", ofi_window),
        "depth_ratio_N": r_mean(UP() / F.greatest(DN(), F.lit(1e-10)), depth_window)})


def multi_level_obi(df: DataFrame, levels: int = 5, step: int = 3, decay: float = 0.8) -> DataFrame:
    df = df.withColumn("obi", B.obi())
    w = [math.exp(-k * decay) for k in range(levels)]
    total = sum(F.avg("obi").over(frame((k + 1) * step)) * w[k] for k in range(levels))
    return df.withColumn("multi_level_obi_N", F.when(RN() >= levels * step - 1, total / sum(w)))


def intensity_group(df: DataFrame, window: int = 10, z_window: int = 20, hhi_window: int = 20) -> DataFrame:
    raw = F.when(C() > 0, div(V() * (H() - L()), C()))
    mu = r_mean(raw, window)
    sd = r_std(V(), z_window, 3)
    s, s2 = r_sum(V(), hhi_window), r_sum(V() * V(), hhi_window)
    return df.withColumns({
        "trade_intensity_N": F.when((mu > 0) & (raw >= 0), div(raw, mu)),
        "trade_count_N": F.when(sd > 1e-14, div(V() - r_mean(V(), z_window, 3), sd)),
        "volume_concentration_hhi_N": F.when(F.count(V()).over(frame(hhi_window)) >= 2,
                                             F.when(s > 0, div(s2, s * s)).when(s.isNotNull(), 0.0))})


def amihud(df: DataFrame, n: int = 15) -> DataFrame:
    df = base(df)
    x = F.when(C() * V() > 0, div(F.abs("ret"), C() * V()))
    return df.withColumn("amihud_illiquidity_N", r_mean(x, n, 1))


def roll_spread(df: DataFrame, n: int = 20, variant: str = "sample") -> DataFrame:
    """2*sqrt(-cov(dp, dp_lag)); 'sample' needs 3 pairs, 'population' 2."""
    df = df.withColumn("_d", C() - lag(C()))
    df = df.withColumn("_dl", lag("_d"))
    ok = F.col("_d").isNotNull() & F.col("_dl").isNotNull()
    d, dl = F.when(ok, F.col("_d")), F.when(ok, F.col("_dl"))
    w = frame(n)
    cov = (F.covar_samp if variant == "sample" else F.covar_pop)(d, dl).over(w)
    v = 2.0 * F.sqrt(F.greatest(F.lit(0.0), -cov))
    need = 3 if variant == "sample" else 2
    out = F.when((RN() >= n) & (F.count(d).over(w) >= need), v)
    return df.withColumn(f"roll_spread_{variant}" if variant != "sample" else "roll_spread_N", out).drop("_d", "_dl")


def noise(df: DataFrame, n: int = 20) -> DataFrame:
    df = base(df).withColumn("_rw", F.when(RN() >= n, r_sum("ret", n)))
    s1, sn = r_std("ret", n, 3), r_std("_rw", n, 3)
    v = F.when((s1 > 1e-14) & (sn > 1e-14), div(math.sqrt(n) * s1, sn))
    return df.withColumn("microstructure_noise_N", clip(v, 0.01, 10.0)).drop("_rw")


def serial_corr(df: DataFrame, n: int = 10) -> DataFrame:
    df = base(df).withColumn("_rl", lag("ret"))
    w = frame(n)
    var_ok = (F.var_pop("_rl").over(w) * (n * n) >= 1e-14) & (F.var_pop("ret").over(w) * (n * n) >= 1e-14)
    r = F.when((RN() >= n + 1) & (F.count("_rl").over(w) >= 4) & var_ok, w_corr(F.when(F.col("ret").isNotNull(), F.col("_rl")), F.when(F.col("_rl").isNotNull(), F.col("ret")), w))
    return df.withColumn("serial_correlation_N", clip(r, -1.0, 1.0)).drop("_rl")


def price_impact(df: DataFrame, n: int = 15) -> DataFrame:
    df = base(df).withColumn("_flow", F.when(F.col("ret").isNotNull(), UP() - DN()))
    w = frame(n)
    m = F.count("_flow").over(w)
    moves = F.var_pop("_flow").over(w) * m * m >= 1e-14
    v = F.when((RN() >= n) & (m >= 3) & moves, w_slope(F.when(F.col("_flow").isNotNull(), F.col("ret")), F.col("_flow"), w))
    return df.withColumn("price_impact_slope_N", v).drop("_flow")


def microprice_group(df: DataFrame, n: int = 5) -> DataFrame:
    """Own-side weighting and the crossed (Stoikov) weighting of low and high."""
    df = base(df)
    tot, mid = UP() + DN(), (H() + L()) * 0.5
    share = div(UP(), tot)
    own = F.when(tot > 0, L() * (1.0 - share) + H() * share).otherwise(mid)
    crossed = F.when(tot > 0, div(L() * UP() + H() * DN(), tot)).otherwise(mid)
    return df.withColumns({"microprice_N": r_mean(own, n), "micro_price_stoikov_N": r_mean(crossed, n)})


def liquidity_vacuum(df: DataFrame, n: int = 10) -> DataFrame:
    sp = F.when(C() > 0, div(H() - L(), C()))
    vm, sm = r_mean(V(), n), r_mean(sp, n)
    vr, sr = F.when(vm > 0, div(V(), vm)), F.when(sm > 0, div(sp, sm))
    vp = F.when(vr.isNotNull(), F.greatest(F.lit(0.0), 1.0 - vr))
    spn = F.when(sr.isNotNull(), F.greatest(F.lit(1.0), sr) - 1.0)
    return df.withColumn("liquidity_vacuum_N", vp * spn)


def vwap_windows(df: DataFrame, n: int = 10, vamp_n: int = 5) -> DataFrame:
    mid = (H() + L()) * 0.5
    ok = mid.isNotNull() & (V() >= 0)
    m, v = F.when(ok, mid), F.when(ok, V())
    w5 = frame(vamp_n)
    vs, pv = F.sum(v).over(w5), F.sum(m * v).over(w5)
    vamp = F.when(vs > 1e-12, div(pv, vs)).otherwise(F.avg(m).over(w5))
    tp = F.when(B.typical_price().isNotNull() & (V() >= 0), B.typical_price())
    wn = frame(n)
    tv = F.sum(F.when(tp.isNotNull(), V())).over(wn)
    vw = div(F.sum(tp * V()).over(wn), tv)
    return df.withColumns({
        "vamp_N": when_ready(vamp, m, vamp_n, 2, True, w5),
        "vwap_mid_deviation_N": when_ready(F.when((tv > 0) & (vw > 0), div(mid - vw, vw)), tp, n, 2, True, wn)})


def orderbook_group(df: DataFrame, window=10, amihud_n=15, roll_n=20, noise_n=20, serial_n=10, vpin_n=50,
                    impact_n=15, micro_n=5, vacuum_n=10, depth_n=5, ofi_n=10, vwap_n=10, count_n=20,
                    hhi_n=20) -> DataFrame:
    df = spread_group(df, window)
    df = imbalance_group(df, window, vpin_n, ofi_n, depth_n)
    df = multi_level_obi(df)
    df = intensity_group(df, window, count_n, hhi_n)
    df = amihud(df, amihud_n)
    df = roll_spread(df, roll_n)
    df = noise(df, noise_n)
    df = serial_corr(df, serial_n)
    df = price_impact(df, impact_n)
    df = microprice_group(df, micro_n)
    df = liquidity_vacuum(df, vacuum_n)
    return vwap_windows(df, vwap_n)


__all__ = [k for k in list(globals()) if not k.startswith("_")]
