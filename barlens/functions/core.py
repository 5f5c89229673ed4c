"""Null-safe arithmetic.  Missing is NULL everywhere, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColLike = Column | str


def c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def div(a: ColLike, b: ColLike) -> Column:
    """a / b, NULL where b is 0 (ANSI mode would raise)."""
    a, b = c(a), c(b)
    return a / F.when(b != 0, b)


def ieee_div(a: ColLike, b: ColLike) -> Column:
    """a / b as floating point has it where b is 0: infinite with the sign of a, NaN for 0 / 0 (ANSI mode would raise)."""
    a, b = c(a).cast("double"), c(b).cast("double")
    inf = float("inf")
    return F.when(b != 0, a / F.when(b != 0, b)).when(b == 0, F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, inf).when(a < 0, -inf))


def ln(x: ColLike) -> Column:
    """Natural log, NULL outside its domain."""
    x = c(x)
    return F.when(x > 0, F.log(F.when(x > 0, x)))


def sqrt0(x: ColLike) -> Column:
    """Square root with negative rounding noise cut to zero."""
    return F.sqrt(F.greatest(c(x), F.lit(0.0)))


def clip(x: ColLike, lo: float, hi: float) -> Column:
    """NULL stays NULL (greatest/least skip NULL arguments)."""
    x = c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def no_nan(x: ColLike) -> Column:
    x = c(x)
    return F.when(~F.isnan(x), x)


def flag(cond: Column) -> Column:
    """1.0 / 0.0 for a condition; unknown counts as 0."""
    return F.when(cond, 1.0).otherwise(0.0)
