"""Moving statistics over a blocked table (see ``plans.ordered.blocked``).

All helpers return Columns over the frame of the last ``n`` rows.  ``full``
asks for ``n`` rows of history, ``mp`` for that many non-NULL values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barlens.functions.core import c, div, sqrt0
from barlens.plans.ordered import frame

def RN() -> Column:
    return F.col("rn")


def when_ready(value: Column, x: Column, n: int, mp: int, full: bool, w) -> Column:
    ok = F.count(x).over(w) >= mp
    if full:
        ok = ok & (RN() >= n - 1)
    return F.when(ok, value)


def roll(fn, x, n: int, mp: int = 2, full: bool = True) -> Column:
    x, w = c(x), frame(n)
    return when_ready(fn(x).over(w), x, n, min(mp, n), full, w)


def r_mean(x, n, mp=2, full=True):
    return roll(F.avg, x, n, mp, full)


def r_sum(x, n, mp=1, full=True):
    return roll(F.sum, x, n, mp, full)


def r_max(x, n, mp=1, full=True):
    return roll(F.max, x, n, mp, full)


def r_min(x, n, mp=1, full=True):
    return roll(F.min, x, n, mp, full)


def r_std(x, n, mp=2, full=True, ddof=1):
    return roll(F.stddev_samp if ddof == 1 else F.stddev_pop, x, n, mp, full)


def r_var(x, n, mp=2, full=True, ddof=1):
    return roll(F.var_samp if ddof == 1 else F.var_pop, x, n, mp, full)


def r_median(x, n, mp=1, full=True):
    """For the short windows of the feature groups; ``plans.order_stats.moving`` serves windows of any length."""
    return roll(lambda v: F.percentile(v, F.lit(0.5)), x, n, mp, full)


def pair(y, x) -> tuple[Column, Column]:
    """Both or neither: the moving pair statistics use complete pairs only."""
    y, x = c(y), c(x)
    both = y.isNotNull() & x.isNotNull()
    return F.when(both, y), F.when(both, x)


def r_cov(y, x, n, mp=2, ddof=1, full=True):
    y, x = pair(y, x)
    w = frame(n)
    f = F.covar_samp if ddof == 1 else F.covar_pop
    return when_ready(f(y, x).over(w), y, n, mp, full, w)


def w_corr(y, x, w) -> Column:
    """Pearson over a window; corr() raises under ANSI where a side does not move."""
    return div(F.covar_pop(y, x).over(w), F.stddev_pop(y).over(w) * F.stddev_pop(x).over(w))


def w_slope(y, x, w) -> Column:
    """Slope of y on x over a window, NULL where x does not move."""
    return div(F.covar_pop(y, x).over(w), F.var_pop(x).over(w))


def r_corr(y, x, n, mp=2, full=True, eps: float = 1e-14):
    """Pearson over complete pairs; NULL where one side does not move."""
    y, x = pair(y, x)
    w = frame(n)
    moving = (F.stddev_pop(y).over(w) >= eps) & (F.stddev_pop(x).over(w) >= eps)
    r = F.when(moving, w_corr(y, x, w))
    return when_ready(F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))), y, n, mp, full, w)


def r_beta(y, x, n, mp=5, full=True, eps: float = 1e-14):
    """Least-squares slope of y on x."""
    y, x = pair(y, x)
    w = frame(n)
    return when_ready(F.when(F.var_pop(x).over(w) >= eps, w_slope(y, x, w)), y, n, mp, full, w)


def r_slope(y, n, mp=None, full=True):
    """Slope against 0..n-1; needs every value of the window."""
    y = c(y)
    w = frame(n)
    pos = RN().cast("double")
    return when_ready(w_slope(y, F.when(y.isNotNull(), pos), w), y, n, mp or n, full, w)


def r_zscore(x, n, mp=2, ddof=1, full=True, eps: float = 1e-14):
    """(x - mean) / std, 0 where the window does not move."""
    x = c(x)
    w = frame(n)
    sd = (F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x)).over(w)
    z = F.when(x.isNotNull(), F.when(sd < eps, 0.0).otherwise(div(x - F.avg(x).over(w), sd)))
    return when_ready(z, x, n, mp, full, w)


def r_skew(x, n, mp=3, full=False):
    """Bias-corrected skewness (G1); 0 for a constant window."""
    x = c(x)
    w = frame(n)
    k = F.count(x).over(w).cast("double")
    g = F.skewness(x).over(w)
    flat = F.var_pop(x).over(w) < 1e-300
    v = F.when(flat, 0.0).otherwise(g * F.sqrt(k * (k - 1)) / F.when(k > 2, k - 2))
    return when_ready(v, x, n, max(mp, 3), full, w)


def r_kurt(x, n, mp=4, full=False):
    """Bias-corrected excess kurtosis (G2); NULL for a constant window."""
    x = c(x)
    w = frame(n)
    k = F.count(x).over(w).cast("double")
    g = F.kurtosis(x).over(w)
    v = F.when(F.var_pop(x).over(w) > 0,
               ((k + 1) * g + 6) * (k - 1) / F.when(k > 3, (k - 2) * (k - 3)))
    return when_ready(v, x, n, max(mp, 4), full, w)


def r_fraction(cond: Column, n: int) -> Column:
    w = frame(n)
    return F.when(RN() >= n - 1, F.avg(F.when(cond, 1.0).otherwise(0.0)).over(w))


def r_list(x, n=None, *, start=None, end=0) -> Column:
    """Non-NULL values of the frame, oldest first."""
    return F.collect_list(c(x)).over(frame(n, start=start, end=end))


def rolling_apply(x, n: int, func, mp: int | None = None) -> Column:
    """Any function of the window given as a Column function over the value array."""
    vals = r_list(x, n)
    return F.when(F.size(vals) >= (n if mp is None else mp), func(vals))


def lag(x, n: int = 1) -> Column:
    return F.lag(c(x), n).over(frame())


def lead(x, n: int = 1) -> Column:
    return F.lead(c(x), n).over(frame())


__all__ = [n for n in dir() if n.startswith(("r_", "w_", "when_ready", "RN", "roll", "lag", "lead", "pair", "sqrt0"))]
