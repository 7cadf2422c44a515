from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_rate(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    """Keep a null null: ``greatest`` and ``least`` alone would replace it by a bound."""
    bounded = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), bounded)


def at_least(value: Column, low: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def at_most(value: Column, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(high)))


def one_if_zero(value: Column) -> Column:
    return F.when(value == 0.0, F.lit(1.0)).otherwise(value)


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows where the condition holds; a null counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation, null for one row or a constant side."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
