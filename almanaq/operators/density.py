"""Weighted Gaussian densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanaq.operators.quantile import exact_quantiles
from almanaq.sources.tables import materialise

SQRT_TWO_PI = 2.5066282746310002
BINS_PER_BANDWIDTH, MOMENTS = 8, 6
#: Different values of a group up to which its quartiles are taken in one task; the results are the same.
HELD_VALUES = 100_000


def bandwidth(n: Column, sd: Column, iqr: Column, size: Column, adjust: float = 1.0) -> Column:
    """Rule of thumb ``0.9 * min(sd, IQR / 1.34) * n ** -0.2 * adjust``.

    A zero minimum falls back to the standard deviation, then to ``|x|``, then to 1.
    """
    steps = [F.nullif(c, F.lit(0.0)) for c in (F.least(sd, iqr / 1.34), sd, size)]
    return 0.9 * F.coalesce(*steps, F.lit(1.0)) * F.pow(n.cast("double"), F.lit(-0.2)) * adjust


def _hermite(u: Column, upto: int) -> list[Column]:
    """Hermite polynomials of the normal density's derivatives."""
    out = [F.lit(1.0), u]
    for k in range(1, upto):
        out.append(u * out[k] - k * out[k - 1])
    return out[:upto + 1]


def weighted_kde(
    df: DataFrame, x: str, weight: str, by: Sequence[str], adjust: float = 1.0, lo: float = 1.0, hi: float = 12.0, n: int = 512,
) -> DataFrame:
    """Density of ``x`` weighted by ``weight`` (normalised to 1 per group), on ``n`` points from ``lo`` to ``hi``.

    The bandwidth ignores the weights, and groups with fewer than two rows are left out. Values are put into bins of an
    eighth of the bandwidth, each with the moments of its values up to the sixth; the kernel is expanded around the bins'
    centres. That departs from the exact sum by less than 1e-10 of the kernel's peak, and a group has no more rows than
    bins, however many different values there are. Quartiles are exact.
    """
    step, middle = (hi - lo) / (n - 1), (lo + hi) / 2
    sums = materialise(
        df.where(F.col(x).isNotNull() & F.col(weight).isNotNull())
        .groupBy(*by, F.col(x).cast("double").alias("_x"))
        .agg(F.sum(F.col(weight).cast("double")).alias("_w"), F.count(F.lit(1)).alias("_rows"))
    )
    # Centred on the grid, so the squares stay small.
    centred, rows = F.col("_x") - middle, F.col("_rows")
    named = [F.col(k).alias(f"_by_{k}") for k in by]
    size = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    few = size <= HELD_VALUES  # one task holds them; more are counted by ranges
    quartiles = F.percentile("_x", F.array(F.lit(0.25), F.lit(0.75)), rows) if few else F.lit(None).cast("array<double>")
    stats = sums.groupBy(*named).agg(
        F.sum(rows).alias("_n"),
        F.sum("_w").alias("_total"),
        F.sum(rows * centred).alias("_s1"),
        F.sum(rows * centred * centred).alias("_s2"),
        quartiles.alias("_q"),
        F.max(F.abs("_x")).alias("_size"),
    ).where(F.col("_n") > 1)
    if not few:
        counted = exact_quantiles(sums, "_x", "_rows", by, (0.25, 0.75)).toDF(*[f"_q_{k}" for k in by], "_found")
        same = [F.col(f"_by_{k}").eqNullSafe(F.col(f"_q_{k}")) for k in by]
        joined = stats.join(counted, same) if by else stats.crossJoin(F.broadcast(counted))  # one row
        stats = joined.withColumn("_q", F.col("_found")).drop("_found", *[f"_q_{k}" for k in by])
    squares = F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n"), F.lit(0.0))
    iqr = F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))
    scale = stats.withColumn("_bw", bandwidth(F.col("_n"), F.sqrt(squares / (F.col("_n") - 1)), iqr, F.col("_size"), adjust))
    match = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by]
    valued = sums.join(scale, match) if by else sums.crossJoin(F.broadcast(scale))  # one row
    width = F.col("_bw") / BINS_PER_BANDWIDTH
    offset = (F.col("_x") - F.col("_centre")) / F.col("_bw")
    share = F.col("_w") / F.nullif(F.col("_total"), F.lit(0.0))
    bins = valued.withColumn("_bin", F.floor(centred / width)).withColumn("_centre", middle + (F.col("_bin") + 0.5) * width).groupBy(*by, "_bin", "_centre", "_bw").agg(
        *[F.sum(share * F.pow(offset, F.lit(float(k))) / math.factorial(k)).alias(f"_m{k}") for k in range(MOMENTS + 1)])
    grid_x = F.lit(lo) + F.col("_i") * F.lit(step)
    z = (grid_x - F.col("_centre")) / F.col("_bw")
    series = sum((F.col(f"_m{k}") * h for k, h in enumerate(_hermite(F.col("_z"), MOMENTS))), F.lit(0.0))
    kernel = F.exp(-0.5 * F.col("_z") * F.col("_z")) / (F.col("_bw") * SQRT_TWO_PI) * series
    points = bins.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_z", z)
    # far from a bin the polynomial may be huge where the exponential is nothing
    value = F.when(F.abs("_z") < 38, kernel).otherwise(F.col("_m0") * 0.0)
    return points.groupBy(*by, "_i").agg(F.sum(value).alias("density")).select(*by, grid_x.alias("x"), "density")
