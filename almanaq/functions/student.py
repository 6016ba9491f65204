"""Student t tail probabilities and quantiles.

Driver-side maths on a handful of numbers; ``two_sided_p_column`` is the Arrow-batched form for tables with one row per
unit.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, lgamma, pi, sqrt, tan
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Degrees of freedom up to which quantiles come from a table; beyond it the expansion is exact to 1e-11.
TABLE_DF = 200


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, modified Lentz evaluation."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, 20000):
        for step in (m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * x * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step * x / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value *= c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    else:
        raise ArithmeticError("the continued fraction did not converge")
    return value


def _incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for arrays of equal length."""
    sizes, at = np.unique(a, return_inverse=True)
    constant = np.array([lgamma(v + b) - lgamma(v) - lgamma(b) for v in sizes])[at]
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(constant + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1.0) / (a + b + 2.0)
    b_all = np.full_like(inner, b)
    out = np.empty_like(inner)
    out[low] = front[low] * _beta_fraction(a[low], b_all[low], inner[low]) / a[low]
    out[~low] = 1.0 - front[~low] * _beta_fraction(b_all[~low], a[~low], 1.0 - inner[~low]) / b
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, out))


def two_sided_p(t, df) -> np.ndarray:
    """P(|T| > |t|) for Student's t; NaN where t is not finite or df is not positive."""
    t = np.atleast_1d(np.asarray(t, dtype=float))
    df = np.broadcast_to(np.asarray(df, dtype=float), t.shape)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    out[ok] = _incomplete_beta(df[ok] / 2.0, 0.5, df[ok] / (df[ok] + t[ok] ** 2))
    return out


def _expansion(p: float) -> tuple[float, tuple[float, ...]]:
    """Normal quantile and the coefficients of 1/df, 1/df^2, ... of the t quantile."""
    z = NormalDist().inv_cdf(p)
    return z, (
        (z ** 3 + z) / 4,
        (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96,
        (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
        (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160,
    )


@lru_cache(maxsize=None)
def quantiles(p: float, up_to: int = TABLE_DF) -> tuple[float, ...]:
    """Upper quantiles of Student's t (p > 0.5) for 1, 2, ... degrees of freedom.

    Closed forms for 1 and 2, Newton steps from the expansion beyond.
    """
    df = np.arange(3, up_to + 1, dtype=float)
    z, terms = _expansion(p)
    t = z + sum(c / df ** i for i, c in enumerate(terms, 1))
    scale = np.array([exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi) for v in df])
    for _ in range(20):
        density = scale * (1 + t * t / df) ** (-(df + 1) / 2)
        step = (0.5 * two_sided_p(t, df) - (1 - p)) / density
        t = t + step
        if np.all(np.abs(step) < 1e-13 * t):
            break
    return (tan(pi * (p - 0.5)), (2 * p - 1) * sqrt(2 / (4 * p * (1 - p))), *(float(v) for v in t))


def quantile_column(p: float, df: Column) -> Column:
    """Upper quantile per row: a table for small degrees of freedom, the inverse-df expansion beyond it."""
    table = F.array(*[F.lit(q) for q in quantiles(p)])
    z, terms = _expansion(p)
    v = df.cast("double")
    series = F.lit(z)
    for power, term in enumerate(terms, 1):
        series = series + F.lit(term) / F.pow(v, F.lit(power))
    return F.when(df < 1, F.lit(None).cast("double")).when(
        df <= TABLE_DF, F.get(table, df.cast("int") - 1)).otherwise(series)


def two_sided_p_column(t: Column, df: float) -> Column:
    """Two-sided p value per row with one common number of degrees of freedom."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        p = two_sided_p(values.to_numpy(dtype=float, na_value=np.nan), df)
        return pd.Series(p).where(~np.isnan(p), None)

    return tail(t)
