"""Per-unit blocks of a panel, the building stone of regressions with a large absorbed factor.

A panel is reduced to one row per unit: its size, its centred cross products, and a sparse list with an entry for each
level of the small factors (years, months) that the unit has: how many rows, and how far their means lie from the
unit's. Dummies are never built. Levels are numbers in the data, never columns or literals of the plan, so a plan has the
same size for ten levels as for two thousand. The small factors' product matrix, at most ``DENSE_LEVELS`` a side, is the
only thing that reaches the driver; with more levels see ``operators.demean``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations_with_replacement

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanaq.operators.within import co_moment

#: Levels whose product matrix is formed and solved on the driver (50 MB); more are solved by rounds in Spark.
DENSE_LEVELS = 2500


def pairs_of(variables: Sequence[str]) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(len(variables)), 2))


def at_once(df: DataFrame, *jobs: Callable):
    """Runs several actions as concurrent Spark jobs."""
    with ThreadPoolExecutor(len(jobs) or 1) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(df.sparkSession)(job)) for job in jobs]]


def count_levels(data: DataFrame, factors: Sequence[str]) -> list[int]:
    """Number of levels of each factor."""
    return at_once(data, *[lambda f=f: data.select(f).distinct().count() for f in factors])


def factor_levels(data: DataFrame, factors: Sequence[str]) -> list[list]:
    """Sorted levels of factors whose levels are known to be few."""
    return at_once(data, *[lambda f=f: sorted(row[f] for row in data.select(f).distinct().collect()) for f in factors])


def number_levels(data: DataFrame, factors: Sequence[str], levels: Sequence[Sequence]) -> DataFrame:
    """``data`` with ``_ids``: the numbers of its levels in the joint list of levels, one per factor."""
    start, names = 0, []
    for i, (f, values) in enumerate(zip(factors, levels)):
        kind = data.schema[f].dataType.simpleString()
        known = data.sparkSession.createDataFrame([(v, start + j) for j, v in enumerate(values)], f"_value_{i} {kind}, _id_{i} int")
        data = data.join(known, F.col(f) == F.col(f"_value_{i}"))
        names.append(f"_id_{i}")
        start += len(values)
    return data.withColumn("_ids", F.array(*names))


def level_counts(numbered: DataFrame, size: int) -> np.ndarray:
    """Rows that have two levels, for all pairs of levels."""
    pairs = numbered.groupBy("_ids").agg(F.count(F.lit(1)).alias("n")).select("n", "_ids", F.explode("_ids").alias("a"))
    return _matrix(pairs.select("n", "a", F.explode("_ids").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("v")), size)


def _matrix(sums: DataFrame, size: int) -> np.ndarray:
    found = sums.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("v").cast("double")).toArrow()
    out = np.zeros((size, size))
    out[np.array(found.column("a")), np.array(found.column("b"))] = np.array(found.column("v"))
    return out


def unit_blocks(numbered: DataFrame, unit: str, variables: Sequence[str]) -> DataFrame:
    """One row per unit: ``n``, ``mean_i``, ``s_i_j`` (centred cross products), ``raw_i`` (uncentred sums of squares), and
    ``entries``: for each level ``k`` of the unit, in order, its rows ``c`` and ``dev_i``, the sum of variable i less its
    unit mean there.

    ``numbered`` comes from ``number_levels``. Two shuffles: partial sums per (unit, level), then per unit. Both carry
    sums, never raw rows.
    """
    pairs = pairs_of(variables)
    rows = numbered.select(unit, *variables, F.posexplode("_ids").alias("_factor", "_k"))
    cells = rows.groupBy(unit, "_factor", "_k").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(v).alias(f"_mean_{i}") for i, v in enumerate(variables)],
        *[co_moment(variables[i], variables[j]).alias(f"_m_{i}_{j}") for i, j in pairs],
    )
    # Cells of the first factor hold all rows of the unit once.
    listed = cells.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(
        F.col("_k").alias("k"), F.col("_factor").alias("f"), F.col("_n").alias("c"),
        *[f"_mean_{i}" for i in range(len(variables))], *[f"_m_{i}_{j}" for i, j in pairs]))).alias("_cells"))

    def total(value: Callable[[Column], Column]) -> Column:
        return F.aggregate("_cells", F.lit(0.0), lambda acc, x: acc + F.when(x["f"] == 0, value(x)).otherwise(0.0))

    listed = listed.withColumn("n", total(lambda x: x["c"].cast("double")).cast("long"))
    listed = listed.withColumns({f"mean_{i}": total(lambda x, i=i: x["c"] * x[f"_mean_{i}"]) / F.col("n") for i in range(len(variables))})
    apart = lambda x, i: x[f"_mean_{i}"] - F.col(f"mean_{i}")
    listed = listed.withColumns({
        f"s_{i}_{j}": total(lambda x, i=i, j=j: x[f"_m_{i}_{j}"] + x["c"] * apart(x, i) * apart(x, j)) for i, j in pairs})
    raw = [(F.col(f"s_{i}_{i}") + F.col("n") * F.col(f"mean_{i}") * F.col(f"mean_{i}")).alias(f"raw_{i}") for i in range(len(variables))]
    entries = F.transform("_cells", lambda x: F.struct(
        x["k"].alias("k"), x["c"].cast("double").alias("c"), *[(x["c"] * apart(x, i)).alias(f"dev_{i}") for i in range(len(variables))]))
    return listed.select(
        unit, "n", *[f"mean_{i}" for i in range(len(variables))], *[f"s_{i}_{j}" for i, j in pairs], *raw, entries.alias("entries"))


def vector(entries: str, value: Callable[[Column], Column], more: Sequence[tuple[int, Column]] = ()) -> Column:
    """A sparse vector of a unit, ``array<struct<k, v>>`` in order of k: a number per entry, and some behind all levels."""
    own = F.transform(entries, lambda x: F.struct(x["k"].alias("k"), value(x).alias("v")))
    return F.concat(own, F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in more])) if more else own


def outer_sums(blocks: DataFrame, vectors: Sequence[Column], size: int) -> np.ndarray:
    """Sum of ``v v'`` over all units and their sparse ``vectors`` (NULL: none), a matrix of ``size`` a side.

    Each pair of entries of a vector is a product; products are added up map-side by their place in the matrix, so a
    partition ships at most the matrix.
    """
    rows = blocks.select(F.explode(F.array(*vectors)).alias("_v")).where("_v is not null").select("_v", F.posexplode("_v").alias("_at", "_a"))
    upper = F.slice("_v", F.col("_at") + 1, F.size("_v"))
    products = rows.select("_a", F.explode(upper).alias("_b")).groupBy(F.col("_a.k").alias("a"), F.col("_b.k").alias("b"))
    half = _matrix(products.agg(F.sum(F.col("_a.v") * F.col("_b.v")).alias("v")), size)
    return half + np.triu(half, 1).T


def level_sums(blocks: DataFrame, names: Sequence[str], size: int) -> np.ndarray:
    """Sums of the entries' fields ``names`` over all units, a line per name and a column per level."""
    sums = blocks.select(F.explode("entries").alias("e")).groupBy("e.k").agg(*[F.sum(f"e.{c}").alias(c) for c in names]).collect()
    out = np.zeros((len(names), size))
    for row in sums:  # a row per level
        out[:, row["k"]] = [row[c] for c in names]
    return out


def unit_sums(blocks: DataFrame, names: Sequence[str]) -> dict[str, float]:
    row = blocks.agg(F.count(F.lit(1)).alias("units"), *[F.sum(c).alias(c) for c in names]).first()
    return {c: row[c] or 0 for c in ("units", *names)}
