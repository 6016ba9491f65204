"""Least squares by orthogonal factorisation (M2, M14): the dummy-variable regression without squaring its condition.

Every task reduces its rows to the triangle R of a QR factorisation, a batch at a time; triangles are stacked and
factorised again in a tree, sixteen to one, until one is left. R has the design's own condition number, where normal
equations have its square, so covariates that nearly follow from each other keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanaq.operators.blocks import count_levels, factor_levels, number_levels
from almanaq.operators.coefficients import coefficient_table
from almanaq.operators.within import model_rows
from almanaq.sources.package import ship_package
from almanaq.sources.tables import discard, materialise

FAN_IN = 16
#: Columns of a design: R is a square of that side, which a task holds a few times.
MAX_COLUMNS = 2000
TOLERANCE = 1e-7  # what is left of a column's length below which it is not identified


def _reduced(*blocks: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def _packed(r: np.ndarray) -> bytes:
    return np.ascontiguousarray(r, "<f8").tobytes()


def triangle(rows: DataFrame, width: int) -> np.ndarray:
    """R of ``rows``: ``_ids`` (columns that are 1, an array) and ``_values`` (the last columns, an array), ``width`` in all."""
    ship_package(rows.sparkSession)
    out = "at long, r binary"

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            n = b.num_rows
            values = np.array(b.column(1).flatten(), float).reshape(n, -1) if n else np.zeros((0, width))
            block = max(1, (1 << 22) // width)  # 32 MB
            ids = b.column(0)
            for lo in range(0, n, block):
                part = min(block, n - lo)
                x = np.zeros((part, width))
                x[:, width - values.shape[1]:] = values[lo:lo + part]
                own = ids.slice(lo, part)
                x[np.repeat(np.arange(part), np.array(own.value_lengths())), np.array(own.flatten(), np.int64)] = 1.0
                r = _reduced(r, x)
        if len(r):
            from pyspark import TaskContext

            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(r)], pa.binary())], ["at", "r"])

    def merge(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("at")
        r = _reduced(*[np.frombuffer(x, "<f8").reshape(-1, width) for x in ordered.column("r").to_pylist()])
        return pa.table({"at": pa.array([ordered.column("at")[0].as_py() // FAN_IN], pa.int64()), "r": pa.array([_packed(r)], pa.binary())})

    level = materialise(rows.select("_ids", "_values").mapInArrow(reduce_rows, out))
    while level.count() > FAN_IN:
        upper = materialise(level.groupBy(F.floor(F.col("at") / FAN_IN)).applyInArrow(merge, out))
        discard(level)
        level = upper
    found = [np.frombuffer(row["r"], "<f8").reshape(-1, width) for row in level.orderBy("at").collect()]  # at most FAN_IN
    discard(level)
    return _reduced(*found) if found else np.zeros((0, width))


def solve_triangle(r: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Least squares of the last column of R on the first ``columns``: estimates, covariance factor's rows, residual sum of
    squares, rank. Columns are taken in order; one that the ones before it explain is not identified (NaN)."""
    a, b = r[:, :columns].copy(), r[:, columns].copy()
    basis: list[np.ndarray] = []
    kept: list[int] = []
    for j in range(columns):
        left = a[:, j].copy()
        for _ in range(2):  # twice is enough for orthogonality to rounding
            for q in basis:
                left -= q * (q @ left)
        size = np.linalg.norm(left)
        if size > TOLERANCE * np.linalg.norm(a[:, j]) and size > 0:
            basis.append(left / size)
            kept.append(j)
    beta, spread = np.full(columns, np.nan), np.full(columns, np.nan)
    if not kept:
        return beta, spread, float(b @ b), 0
    q, t = np.linalg.qr(a[:, kept])
    beta[kept] = np.linalg.solve(t, q.T @ b)
    inverse = np.linalg.solve(t, np.eye(len(kept)))
    spread[kept] = np.sqrt((inverse ** 2).sum(1))
    rest = b - q @ (q.T @ b)
    return beta, spread, float(rest @ rest), len(kept)


def lm_qr(df: DataFrame, y: str, xs: Sequence[str], factors: Sequence[str] = ()) -> DataFrame:
    """OLS of y on xs, an intercept, and a dummy for every level but the first of every factor, by QR.

    For factors with few levels (years, months): the design has at most ``MAX_COLUMNS`` columns. Rows with a missing
    variable are dropped. The table has the covariates' rows.
    """
    data = model_rows(df, list(factors), [y, *xs])
    sizes = count_levels(data, factors)
    first = 1 + sum(n - 1 for n in sizes)
    width = first + len(xs) + 1
    if width > MAX_COLUMNS:
        raise ValueError(f"a design of {width} columns is too wide; absorb the larger factors instead")
    means = data.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate([*xs, y])]).first()
    n = means["n"]
    if not n:
        raise ValueError("no complete rows")
    dummy = F.array(F.lit(0))
    if factors:
        levels = factor_levels(data, factors)
        data = number_levels(data, factors, levels)
        # the number of a level in the design: behind the intercept, without the first level of each factor
        starts = np.cumsum([0, *[len(v) for v in levels]])[:-1]
        ids = [F.get("_ids", F.lit(i)) for i in range(len(factors))]
        parts = [F.when(c > int(s), (c - i).cast("int")) for i, (c, s) in enumerate(zip(ids, starts))]
        dummy = F.filter(F.array(F.lit(0), *parts), lambda c: c.isNotNull())
    # The intercept takes the means up; without them the triangle keeps more digits of what varies.
    values = F.array(*[F.col(c) - F.lit(means[f"m{i}"]) for i, c in enumerate([*xs, y])])
    r = triangle(data.select(dummy.alias("_ids"), values.alias("_values")), width)
    beta, spread, rss, rank = solve_triangle(np.vstack([r, np.zeros((max(width - len(r), 0), width))]), width - 1)
    df_resid = int(n - rank)
    sigma2 = rss / df_resid if df_resid > 0 else np.nan
    return coefficient_table(df.sparkSession, list(xs), beta[first:], np.sqrt(sigma2) * spread[first:], df_resid, {"n_obs": int(n)})
