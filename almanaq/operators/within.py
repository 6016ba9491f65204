"""One-way within regression (M1, M5)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanaq.operators.coefficients import coefficient_table, solve_normal, variation_scale


def model_rows(df: DataFrame, factors: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """The model's columns, variables as doubles, without incomplete rows."""
    return df.select(*factors, *[F.col(v).cast("double").alias(v) for v in variables]).dropna()


def co_moment(a: str, b: str):
    """Centred cross product of a group; merges across partitions without losing digits."""
    return F.covar_pop(a, b) * F.count(F.lit(1))


def fe_within(df: DataFrame, y: str, xs: Sequence[str], by: str) -> DataFrame:
    """OLS of y on xs after removing the mean of each ``by`` group.

    One pass: every group yields its size and centred cross products, these are added up, and a k x k system is solved.
    No row is demeaned and nothing is joined. Residual degrees of freedom are rows - groups - k. A third index name in
    the panel does not enter: the unit panel takes the same call.
    """
    variables = [y, *xs]
    pairs = list(combinations_with_replacement(range(len(variables)), 2))
    data = model_rows(df, [by], variables)
    moments = data.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *[co_moment(variables[i], variables[j]).alias(f"m_{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(v) * F.col(v)).alias(f"raw_{i}") for i, v in enumerate(variables)],
        *[F.sum(v).alias(f"sum_{i}") for i, v in enumerate(variables)],
    )
    total = moments.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
        *[F.sum(f"m_{i}_{j}").alias(f"m_{i}_{j}") for i, j in pairs],
        *[F.sum(c).alias(c) for i in range(len(variables)) for c in (f"raw_{i}", f"sum_{i}")],
    ).first()
    if not total["n"]:
        raise ValueError("no complete rows")
    w = np.zeros((len(variables), len(variables)))
    for i, j in pairs:
        w[i, j] = w[j, i] = total[f"m_{i}_{j}"]
    raw, sums = (np.array([total[f"{c}_{i}"] for i in range(1, len(variables))]) for c in ("raw", "sum"))
    scale = variation_scale(raw - sums ** 2 / total["n"], raw)
    beta, inverse, rank = solve_normal(w[1:, 1:], w[1:, 0], scale)
    rss = max(w[0, 0] - np.nansum(beta * w[1:, 0]), 0.0)
    df_resid = int(total["n"] - total["groups"] - rank)
    sigma2 = rss / df_resid if df_resid > 0 else np.nan
    return coefficient_table(
        df.sparkSession, list(xs), beta, np.sqrt(sigma2 * np.diag(inverse)), df_resid,
        {"n_obs": int(total["n"]), "r_squared": 1.0 - rss / w[0, 0] if w[0, 0] > 0 else np.nan},
    )
