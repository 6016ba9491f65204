"""Coefficient tables: one row per term, built from numbers already reduced on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanaq.functions.student import two_sided_p


def _clean(x: float) -> float | None:
    return float(x) if np.isfinite(x) else None


def coefficient_table(
    spark: SparkSession, terms: Sequence[str], estimate: np.ndarray, std_error: np.ndarray, df_resid: int,
    extra: Mapping[str, float | int] | None = None,
) -> DataFrame:
    """``(term, estimate, std_error, t_value, p_value, df_resid, ...extra)``; NaN estimates become NULL."""
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.asarray(estimate, dtype=float) / np.asarray(std_error, dtype=float)
    p = two_sided_p(t, df_resid)
    extra = dict(extra or {})
    kinds = ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in extra.items())
    schema = "term string, estimate double, std_error double, t_value double, p_value double, df_resid long"
    rows = [
        (term, _clean(b), _clean(s), _clean(tv), _clean(pv), int(df_resid),
         *[v if isinstance(v, int) else _clean(v) for v in extra.values()])
        for term, b, s, tv, pv in zip(terms, estimate, std_error, t, p)
    ]
    return spark.createDataFrame(rows, schema + (", " + kinds if kinds else ""))


def coef_interval(coefs: DataFrame, term: str | None = None, mult: float = 2.0) -> DataFrame:
    """Adds ``lower`` and ``upper`` = estimate -/+ ``mult`` standard errors, optionally for one term only."""
    if term is not None:
        coefs = coefs.where(F.col("term") == term)
    half = mult * F.col("std_error")
    return coefs.withColumns({"lower": F.col("estimate") - half, "upper": F.col("estimate") + half})


def terms_matching(coefs: DataFrame, pattern: str) -> DataFrame:
    """The rows whose term matches a regular expression."""
    return coefs.where(F.col("term").rlike(pattern))


def solve_normal(a: np.ndarray, b: np.ndarray, scale: np.ndarray, rtol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, int]:
    """Solves ``a x = b`` for a small positive semi-definite ``a``: ``(x, inverse, rank)``.

    Columns are taken in order; one whose remaining variation is below ``rtol`` of ``scale`` (see ``variation_scale``)
    is not identified and gets NaN.
    """
    k = len(b)
    kept: list[int] = []
    for j in range(k):
        left = a[j, j]
        if kept:
            block = a[np.ix_(kept, kept)]
            left = left - a[j, kept] @ np.linalg.solve(block, a[kept, j])
        if left > rtol * scale[j]:
            kept.append(j)
    x, inverse = np.full(k, np.nan), np.full((k, k), np.nan)
    if kept:
        inner = np.linalg.inv(a[np.ix_(kept, kept)])
        inverse[np.ix_(kept, kept)] = (inner + inner.T) / 2
        x[kept] = np.linalg.solve(a[np.ix_(kept, kept)], b[kept])
    return x, inverse, len(kept)


def variation_scale(centred: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Yardstick for remaining variation: the centred sum of squares, but not below what rounding makes of the raw one."""
    return np.maximum(centred, 1e-10 * raw)
