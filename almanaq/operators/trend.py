"""Straight-line trends with confidence bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanaq.functions.scalar import ratio
from almanaq.functions.student import quantile_column


def trend_lines(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Least-squares line of y on x per group: one aggregate, no join.

    ``s`` is the residual standard error (NULL below three points); groups without spread in x are left out.
    """
    pair = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({
        "_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    fitted = pair.groupBy(*by).agg(
        F.regr_count("_y", "_x").cast("long").alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.avg("_x").alias("x_mean"),
        F.regr_sxx("_y", "_x").alias("sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
        F.min("_x").alias("x_min"),
        F.max("_x").alias("x_max"),
    )
    rss = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    s = F.when(F.col("n") > 2, F.sqrt(ratio(rss, (F.col("n") - 2).cast("double"))))
    return fitted.where(F.col("sxx") > 0).withColumn("s", s).drop("_syy", "_sxy")


def trend_lm(df: DataFrame, y: str, x: str, by: Sequence[str], grid: int = 80, level: float = 0.95) -> DataFrame:
    """Trend line and confidence band of each group on ``grid`` points over the group's own range of x."""
    lines = trend_lines(df, y, x, by)
    step = (F.col("x_max") - F.col("x_min")) / F.lit(float(grid - 1))
    points = lines.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn(
        "x", F.col("x_min") + F.col("_i") * step)
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    se = F.col("s") * F.sqrt(1.0 / F.col("n") + F.pow(F.col("x") - F.col("x_mean"), F.lit(2)) / F.col("sxx"))
    half = quantile_column((1 + level) / 2, F.col("n") - 2) * F.col("se")
    return (
        points.withColumns({"fit": fit, "se": se})
        .withColumns({"lower": F.col("fit") - half, "upper": F.col("fit") + half})
        .select(*by, "x", "fit", "se", "lower", "upper")
    )
