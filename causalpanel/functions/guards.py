"""Null- and zero-safe column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def safe_denominator(d: Column, eps: float = EPSILON) -> Column:
    """``d`` kept at least ``eps`` away from zero, its sign preserved; exact zero becomes ``eps``."""
    return F.when(F.abs(d) < eps, F.when(d < 0, F.lit(-eps)).otherwise(F.lit(eps))).otherwise(d)


def safe_div(n: Column, d: Column, eps: float = EPSILON) -> Column:
    return n / safe_denominator(d, eps)


def is_missing(c: Column) -> Column:
    """NULL or NaN."""
    return c.isNull() | F.isnan(c)


def inf_to_null(c: Column) -> Column:
    return F.when(~c.isin(float("inf"), float("-inf")), c)


def null_safe_clip(c: Column, low: Column, high: Column) -> Column:
    """``c`` within [low, high]; missing values stay as they are."""
    return F.when(is_missing(c), c).otherwise(F.greatest(F.least(c, high), low))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL for fewer than two values on either side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)))


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def average_rank(c: Column, partition: list[str]) -> Column:
    """Rank from 1 within ``partition``, ties sharing their mean rank."""
    from pyspark.sql import Window

    ordered = Window.partitionBy(*partition).orderBy(c)
    peers = Window.partitionBy(*partition, c)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / 2.0
