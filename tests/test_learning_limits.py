"""Win rates that lie on a limit of the learning multiplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.operators import trades as A


def test_a_win_rate_on_the_limit_counts(spark):
    """87 of 150 are 58 %; as a share times 100 that is a little less."""
    assert 87 / 150 * 100.0 < 58
    t = spark.range(150).select(*[F.lit("x").alias(k) for k in ("symbol", "interval", "mode", "direction", "regime")], F.lit(34.0).alias("confidence"),
                                F.when(F.col("id") < 87, 1.0).otherwise(-1.0).alias("realized_r"))
    r = A.learning_multiplier(t, t.drop("realized_r").distinct()).first()
    assert (r.multiplier, r.sample_size, r.scope) == (1.1, 150, "EXACT")
