"""Aggregate expressions that stay exact and safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(c: Column | str) -> Column:
    """SUM in the column's own (decimal) type, given out as double."""
    return F.sum(as_col(c)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean(c: Column | str) -> Column:
    """AVG as exact sum over count, so that decimals do not lose digits."""
    return ratio(F.sum(as_col(c)), F.count(as_col(c)))

