"""Removing two large factors by conjugate gradients, for regressions whose factors have too many levels for a matrix.

The effects of the second factor solve a system in which the first one (the unit) is already eliminated. Its matrix is
never formed: a product with it is a join of the (unit, level) cells with the levels' numbers, sums per unit, a join
back, and sums per level. All variables are solved side by side. Rounds go on until every residual is small against its
variable's size: a variable without an effect starts with rounding errors, which no round makes smaller.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanaq.operators.graph import connected
from almanaq.sources.tables import discard, materialise

TOLERANCE = 1e-13  # residual, weighted by the levels' rows, against the root of the variable's sum of squares
_PATIENCE = 500  # rounds without a smaller residual mean that it can't get smaller


def components_of(cells: DataFrame, unit: str, level: str) -> int:
    """Connected components of the graph in which a cell joins its unit and its level.

    A level links its units, so the units' graph has as many: each unit with the smallest one of each of its levels. It
    has an edge per different pair, far fewer than cells where levels share their smallest units.
    """
    least = cells.groupBy(level).agg(F.min(unit).alias("b"))
    edges = materialise(cells.select(F.col(unit).alias("a"), level).join(least, level).select("a", "b").distinct())
    found = connected(edges).select("component").distinct().count()
    discard(edges)
    return found


def _sums(of: Sequence[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in of]


def two_way_effects(
        cells: DataFrame, unit: str, level: str, count: str, variables: Sequence[str], squares: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Effects ``(level, e_i)`` and ``(unit, e_i)`` of the sums ``variables`` in ``cells (unit, level, count)``.

    What is left of a row's variable i after its level's and its unit's effect is orthogonal to both factors. ``squares``
    are the sums of squares of the rows' variables; a residual can't be larger.
    """
    k = range(len(variables))
    per_unit = materialise(cells.groupBy(unit).agg(F.sum(count).alias("_nu"), *[(F.sum(v) / F.sum(count)).alias(f"_mean_{i}") for i, v in enumerate(variables)]))
    wide = cells.join(per_unit, unit)
    held = cells.select(unit, level, F.col(count).alias("_n"))
    in_unit = per_unit.select(unit, "_nu")
    start = wide.groupBy(level).agg(
        F.sum(count).cast("double").alias("n"), *[F.sum(F.col(v) - F.col(count) * F.col(f"_mean_{i}")).alias(f"r_{i}") for i, v in enumerate(variables)])
    state = materialise(start.select(level, "n", *[F.lit(0.0).alias(f"x_{i}") for i in k], *[f"r_{i}" for i in k], *[(F.col(f"r_{i}") / F.col("n")).alias(f"p_{i}") for i in k]))
    size, best, waited = np.array(squares, float), np.inf, 0
    while True:
        moved = held.join(state.select(level, *[f"p_{i}" for i in k]), level)
        sums = moved.groupBy(unit).agg(*[F.sum(F.col("_n") * F.col(f"p_{i}")).alias(f"q_{i}") for i in k])
        mean = sums.join(in_unit, unit).select(unit, *[(F.col(f"q_{i}") / F.col("_nu")).alias(f"q_{i}") for i in k])
        back = held.join(mean, unit).groupBy(level).agg(*[F.sum(F.col("_n") * F.col(f"q_{i}")).alias(f"q_{i}") for i in k])
        step = materialise(state.join(back, level).select(
            level, "n", *[f"{c}_{i}" for c in "xrp" for i in k], *[(F.col("n") * F.col(f"p_{i}") - F.col(f"q_{i}")).alias(f"s_{i}") for i in k]))
        row = step.agg(*[F.sum(F.col(f"{a}_{i}") * F.col(f"{b}_{i}") / (F.col("n") if (a, b) != ("p", "s") else F.lit(1.0))).alias(f"{a}{b}_{i}")
                         for a, b in ("rr", "ps", "rs", "ss") for i in k]).first()
        rr, ps, rs, ss = (np.array([row[f"{ab}_{i}"] or 0.0 for i in k]) for ab in ("rr", "ps", "rs", "ss"))
        ratio = float(np.sqrt(np.max(np.divide(rr, size, out=np.zeros(len(rr)), where=size > 0), initial=0.0)))
        discard(state)
        state = step
        if ratio <= TOLERANCE:
            break
        waited = 0 if ratio < best else waited + 1
        best = min(best, ratio)
        if waited == _PATIENCE:
            raise ArithmeticError(f"the effects of {unit} and {level} did not converge: {ratio:.1e} left")
        alpha = np.divide(rr, ps, out=np.zeros(len(rr)), where=ps > 0)
        left = np.maximum(rr - 2 * alpha * rs + alpha ** 2 * ss, 0.0)
        beta = np.divide(left, rr, out=np.zeros(len(rr)), where=rr > 0)
        rest = [F.col(f"r_{i}") - F.lit(float(alpha[i])) * F.col(f"s_{i}") for i in k]
        state = materialise(step.select(
            level, "n", *[(F.col(f"x_{i}") + F.lit(float(alpha[i])) * F.col(f"p_{i}")).alias(f"x_{i}") for i in k],
            *[rest[i].alias(f"r_{i}") for i in k], *[(rest[i] / F.col("n") + F.lit(float(beta[i])) * F.col(f"p_{i}")).alias(f"p_{i}") for i in k]))
        discard(step)
    effects = state.select(level, *[F.col(f"x_{i}").alias(f"e_{i}") for i in k])
    of = held.join(effects, level).groupBy(unit).agg(*[F.sum(F.col("_n") * F.col(f"e_{i}")).alias(f"_of_{i}") for i in k])
    units = per_unit.join(of, unit).select(unit, *[(F.col(f"_mean_{i}") - F.col(f"_of_{i}") / F.col("_nu")).alias(f"e_{i}") for i in k])
    units = materialise(units)
    discard(per_unit)
    return effects, units
