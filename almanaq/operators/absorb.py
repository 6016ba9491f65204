"""Regressions with several absorbed factors (M2, M3, M4)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanaq.operators.blocks import (
    DENSE_LEVELS, at_once, count_levels, factor_levels, level_counts, level_sums, number_levels, outer_sums, pairs_of, unit_blocks, unit_sums, vector,
)
from almanaq.operators.coefficients import coefficient_table, solve_normal, variation_scale
from almanaq.operators.demean import components_of, two_way_effects
from almanaq.operators.within import model_rows
from almanaq.sources.tables import discard, materialise


def _drop_first(levels: Sequence[Sequence]) -> list[int]:
    """Positions of all levels but the first of each factor."""
    kept, start = [], 0
    for values in levels:
        kept += range(start + 1, start + len(values))
        start += len(values)
    return kept


def absorb_ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], dense_levels: int = DENSE_LEVELS) -> DataFrame:
    """OLS of y on xs with a dummy for every level of every factor in ``by``, without building dummies.

    ``by[0]`` is eliminated in Spark and may have any number of levels (the units). While the others have at most
    ``dense_levels`` together, their product matrix is solved on the driver, exactly, without iteration. Beyond that the
    largest of them is removed together with the units by conjugate gradients in Spark; what is left of the others must
    be few. Both ways give the same table.
    """
    data = model_rows(df, list(by), [y, *xs])
    factors = list(by[1:])
    sizes = count_levels(data, factors)
    if factors and not min(sizes):
        raise ValueError("no complete rows")
    if sum(sizes) <= dense_levels:
        return _absorb_by_matrix(data, y, xs, by[0], factors)
    large = factors.pop(int(np.argmax(sizes)))
    if sum(sizes) - max(sizes) > dense_levels:
        raise ValueError(f"only two factors may have many levels; {factors} have too many besides {by[0]} and {large}")
    return _absorb_by_rounds(data, y, xs, by[0], large, factors)


def _absorb_by_matrix(data: DataFrame, y: str, xs: Sequence[str], unit: str, factors: list[str]) -> DataFrame:
    variables = [y, *xs]
    levels, k = factor_levels(data, factors), len(xs)
    size = sum(map(len, levels))
    pairs = pairs_of(variables)
    numbered = number_levels(data, factors, levels)
    blocks = materialise(unit_blocks(numbered, unit, variables))
    share = vector("entries", lambda x: x["c"] / F.sqrt("n"))
    names = ["n", *[f"s_{i}_{j}" for i, j in pairs], *[f"raw_{i}" for i in range(1, k + 1)]]
    jobs = [lambda: outer_sums(blocks, [share], size), lambda: level_sums(blocks, ["c", *[f"dev_{i}" for i in range(k + 1)]], size),
            lambda: unit_sums(blocks, names), *([lambda: level_counts(numbered, size)] if len(factors) > 1 else [])]
    outer, lines, total, *counted = at_once(data, *jobs)
    counts, cross = counted[0] if counted else np.diag(lines[0]), lines[1:]
    discard(blocks)
    small = counts - outer

    w = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        w[i, j] = w[j, i] = total[f"s_{i}_{j}"]
    keep = _drop_first(levels)
    d, c = small[np.ix_(keep, keep)], cross[:, keep]
    # Removing the small factors. A level that the others already determine is left out of the rank.
    _, inverse_d, rank_d = solve_normal(d, np.zeros(len(keep)), np.diag(counts)[keep])
    inverse_d = np.nan_to_num(inverse_d)
    left = w - c @ inverse_d @ c.T
    scale = variation_scale(np.diag(w)[1:], np.array([total[f"raw_{i}"] for i in range(1, k + 1)]))
    return _table(data, xs, left, scale, int(total["n"]), int(total["units"]) + rank_d)


def _table(data: DataFrame, xs: Sequence[str], left: np.ndarray, scale: np.ndarray, n: int, absorbed: int) -> DataFrame:
    """From the products of y and xs without the factors."""
    beta, inverse, rank = solve_normal(left[1:, 1:], left[1:, 0], scale)
    rss = max(left[0, 0] - np.nansum(beta * left[1:, 0]), 0.0)
    df_resid = n - absorbed - rank
    sigma2 = rss / df_resid if df_resid > 0 else np.nan
    return coefficient_table(data.sparkSession, list(xs), beta, np.sqrt(sigma2 * np.diag(inverse)), df_resid, {"n_obs": n})


def _absorb_by_rounds(data: DataFrame, y: str, xs: Sequence[str], unit: str, large: str, factors: list[str]) -> DataFrame:
    levels, k = factor_levels(data, factors), len(xs)
    dummies = _drop_first(levels)
    if factors:
        data = number_levels(data, factors, levels)
    # Variables less their means (a shift that both factors absorb): y, xs, then the few levels of the other factors.
    means = data.agg(*[F.avg(v).alias(f"_{i}") for i, v in enumerate([y, *xs])]).first()
    columns = [(F.col(v) - F.lit(means[i])).alias(f"v_{i}") for i, v in enumerate([y, *xs])]
    columns += [F.array_contains("_ids", d).cast("double").alias(f"v_{k + 1 + i}") for i, d in enumerate(dummies)]
    m = len(columns)
    rows = materialise(data.select(F.col(unit).alias("u"), F.col(large).alias("l"), *columns))
    cells = materialise(rows.groupBy("u", "l").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"v_{i}").alias(f"t_{i}") for i in range(m)]))
    squares = rows.agg(*[F.sum(F.col(f"v_{i}") * F.col(f"v_{i}")) for i in range(m)]).first()
    by_level, by_unit = two_way_effects(cells, "u", "l", "n", [f"t_{i}" for i in range(m)], [x or 0.0 for x in squares])
    a = by_level.select("l", *[F.col(f"e_{i}").alias(f"a_{i}") for i in range(m)])
    b = by_unit.select("u", *[F.col(f"e_{i}").alias(f"b_{i}") for i in range(m)])
    wide = rows.join(a, "l").join(b, "u").select(
        *[(F.col(f"v_{i}") - F.col(f"a_{i}") - F.col(f"b_{i}")).alias(f"w_{i}") for i in range(m)])
    pairs = pairs_of(range(m))
    total, units, level_n, parts = at_once(
        data,
        lambda: wide.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"w_{i}") * F.col(f"w_{j}")).alias(f"s_{i}_{j}") for i, j in pairs]).first(),
        lambda: by_unit.count(), lambda: by_level.count(), lambda: components_of(cells, "u", "l"))
    w = np.zeros((m, m))
    for i, j in pairs:
        w[i, j] = w[j, i] = total[f"s_{i}_{j}"]
    raw = np.array([x or 0.0 for x in squares])
    discard(rows, cells)
    # The other factors' levels first, then the covariates in what they leave.
    d, own = list(range(k + 1, m)), list(range(k + 1))
    _, inverse_d, rank_d = solve_normal(w[np.ix_(d, d)], np.zeros(len(d)), raw[d])
    c = w[np.ix_(own, d)]
    left = w[np.ix_(own, own)] - c @ np.nan_to_num(inverse_d) @ c.T
    return _table(data, xs, left, raw[1:k + 1], int(total["n"]), units + level_n - parts + rank_d)
