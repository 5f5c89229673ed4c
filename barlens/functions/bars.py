"""Per-bar scalar expressions (no window)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from barlens.functions.core import c, clip, div, flag, ln

def O() -> Column:
    return F.col("open")


def H() -> Column:
    return F.col("high")


def L() -> Column:
    return F.col("low")


def C() -> Column:
    return F.col("close")


def V() -> Column:
    return F.col("volume")


def typical_price() -> Column:
    return (H() + L() + C()) / 3.0


def dollar_volume() -> Column:
    return C() * V()


def body_ratio() -> Column:
    return div(F.abs(C() - O()), H() - L())


def upper_wick_ratio() -> Column:
    return div(H() - F.greatest(O(), C()), H() - L())


def lower_wick_ratio() -> Column:
    return div(F.least(O(), C()) - L(), H() - L())


def up_volume() -> Column:
    return F.when(C() > O(), V()).when(C() < O(), F.lit(0.0)).otherwise(V() * 0.5)


def down_volume() -> Column:
    return F.when(C() < O(), V()).when(C() > O(), F.lit(0.0)).otherwise(V() * 0.5)


def obi() -> Column:
    """Volume imbalance of one bar, 0 without volume."""
    total = up_volume() + down_volume()
    return F.when(total > 0, div(up_volume() - down_volume(), total)).otherwise(0.0)


def taker_buy(real: Column | None = None) -> Column:
    """Taker buy volume, or its estimate from the close position in the range."""
    rng = F.when(H() > L(), H() - L()).otherwise(F.lit(1e-10))
    proxy = F.when(V().isNotNull(), F.least(F.greatest(V() * (C() - L()) / rng, F.lit(0.0)), V()))
    return proxy if real is None else F.coalesce(real, proxy)


def is_doji(threshold: float = 0.1) -> Column:
    return F.coalesce(div(F.abs(C() - O()), F.when(H() > L(), H() - L())) <= threshold, F.lit(False))


def is_marubozu(threshold: float = 0.2) -> Column:
    shadow = (H() - F.greatest(O(), C())) + (F.least(O(), C()) - L())
    return F.coalesce(div(shadow, F.when(H() > L(), H() - L())) * 2.0 <= threshold, F.lit(False))


def is_hammer() -> Column:
    """Hammer or its mirror image, the shooting star."""
    body, up, dn = F.abs(C() - O()), H() - F.greatest(O(), C()), F.least(O(), C()) - L()
    hit = ((dn >= 2.0 * body) & (up <= 0.3 * body)) | ((up >= 2.0 * body) & (dn <= 0.3 * body))
    return (H() > L()) & (body > 0) & hit


def is_engulfing(prev_open: Column, prev_close: Column) -> Column:
    bull = (prev_close < prev_open) & (C() > O()) & (O() < prev_close) & (C() > prev_open)
    bear = (prev_close > prev_open) & (C() < O()) & (O() > prev_close) & (C() < prev_open)
    return F.coalesce(bull | bear, F.lit(False))


def is_gap(prev_close: Column) -> Column:
    return F.coalesce((O() > prev_close * 1.001) | (O() < prev_close * 0.999), F.lit(False))


def parkinson_spread() -> Column:
    return F.sqrt((H() - L()) * (H() - L()) / (4.0 * math.log(2.0)))


def corwin_schultz(prev_high: Column, prev_low: Column) -> Column:
    """Two-bar high/low spread estimate; NULL where it is not positive."""
    inv = 1.0 / (3.0 - 2.0 * math.sqrt(2.0))
    beta = F.pow(ln(div(prev_high, prev_low)), 2) + F.pow(ln(div(H(), L())), 2)
    gamma = F.pow(ln(div(F.greatest(prev_high, H()), F.least(prev_low, L()))), 2)
    alpha = (F.sqrt(2.0 * beta) - F.sqrt(beta)) * inv - F.sqrt(gamma * inv)
    ok = (prev_high > 0) & (prev_low > 0) & (H() > 0) & (L() > 0) & (alpha > 0)
    return F.when(ok, 2.0 * (F.exp(alpha) - 1.0) / (1.0 + F.exp(alpha)))


def cs_proxy(h_l_sq: Column, prev_h_l_sq: Column) -> Column:
    """Simplified spread proxy: single-bar gamma, exponent clipped to +-5."""
    beta = prev_h_l_sq + h_l_sq
    a = F.sqrt(2.0 * F.when(beta != 0, beta)) - F.sqrt(F.when(h_l_sq != 0, h_l_sq))
    e = F.exp(clip(a, -5.0, 5.0))
    return 2.0 * (e - 1.0) / (1.0 + e)


def basis_bps(premium: Column, index: Column | None = None) -> Column:
    return c(premium) if index is None else (div(premium, index) - 1.0) * 10000.0


def basis_regime(basis: Column, threshold: float = 2.0) -> Column:
    b = c(basis)
    return F.when(b.isNull(), None).when(b > threshold, 1.0).when(b < -threshold, -1.0).otherwise(0.0)


def calendar(ts: Column) -> dict[str, Column]:
    hour, dow = F.hour(ts), F.weekday(ts)
    a, b = hour * (2.0 * math.pi / 24.0), dow * (2.0 * math.pi / 7.0)
    return {"hour_of_day_sin": F.sin(a), "hour_of_day_cos": F.cos(a), "day_of_week_sin": F.sin(b),
            "day_of_week_cos": F.cos(b), "is_us_hours": flag((hour >= 14) & (hour < 20))}


# fixed values: session bands by UTC hour
SESSIONS = [(0, 7, "ASIA", 0.65), (7, 12, "LONDON", 0.9), (12, 16, "LONDON_NEW_YORK_OVERLAP", 1.0),
            (16, 21, "NEW_YORK", 0.95)]


def session_label(ts: Column) -> tuple[Column, Column]:
    hour = F.hour(ts)
    label, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    label = F.when(hour.isNull(), label)
    score = F.when(hour.isNull(), score)
    for lo, hi, name, s in SESSIONS:
        label = label.when((hour >= lo) & (hour < hi), name)
        score = score.when((hour >= lo) & (hour < hi), s)
    return label.otherwise("OFF_HOURS"), score.otherwise(0.5)


