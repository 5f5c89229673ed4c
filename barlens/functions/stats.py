"""Group statistics that stay defined where Spark's own raise under ANSI."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barlens.functions.core import c, div


def corr_agg(y, x) -> Column:
    """Pearson of complete pairs as a group aggregate; NULL at zero variance."""
    y, x = c(y), c(x)
    both = y.isNotNull() & x.isNotNull()
    y, x = F.when(both, y), F.when(both, x)
    return div(F.covar_pop(y, x), F.stddev_pop(y) * F.stddev_pop(x))
