"""Scalar and aggregate expressions with explicit missing-value rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanaq.fixed import ABOVE, BELOW
from almanaq.functions.calendar import _col


def strict_sum(c: Column | str) -> Column:
    """Sum that is NULL as soon as one value of the group is NULL."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def skip_sum(c: Column | str) -> Column:
    """Sum over the non-NULL values, 0 when there is none."""
    total = F.sum(_col(c))
    return F.coalesce(total, F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL when ``b`` is 0."""
    return a / F.nullif(b, F.lit(0.0))


def above_below(deviation: Column | str) -> Column:
    """Direction of a deviation: zero counts as below, NULL stays NULL."""
    d = _col(deviation)
    return F.when(d > 0, F.lit(ABOVE)).when(d.isNotNull(), F.lit(BELOW))


def prefer(*columns: Column | str) -> Column:
    """The first of several columns that has a value."""
    return F.coalesce(*[_col(c) for c in columns])


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def signed_sqrt(c: Column | str) -> Column:
    c = _col(c)
    return F.signum(c) * F.sqrt(F.abs(c))


def null_if_nan(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)
