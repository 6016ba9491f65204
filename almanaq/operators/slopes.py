"""Unit-specific slopes (M6, M12)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanaq.functions.scalar import ratio
from almanaq.functions.student import two_sided_p_column
from almanaq.operators.blocks import (
    DENSE_LEVELS, at_once, count_levels, factor_levels, level_sums, number_levels, outer_sums, pairs_of, unit_blocks, unit_sums, vector,
)
from almanaq.operators.coefficients import solve_normal, variation_scale
from almanaq.operators.within import model_rows
from almanaq.sources.tables import materialise


def unit_slopes(df: DataFrame, y: str, x: str, zs: Sequence[str], unit: str, by: str) -> DataFrame:
    """Slope of y on x for every unit, with unit intercepts, shared covariates ``zs`` and ``by`` (year) dummies.

    One row per unit: ``slope`` with its standard error, t and p, and ``slope_minus_ref``, the difference to the
    reference unit (the smallest unit key), with its own. The reference unit's difference is NULL, as is everything of
    a unit whose x does not vary.

    Each unit's intercept and slope are eliminated in Spark, the shared effects are solved on the driver (one number
    per year and covariate), and the slopes are solved back in Spark, one row per unit. The shared effects and their
    covariance go back as tables that are joined, never as literals of the plan.
    """
    variables = [y, x, *zs]
    data = model_rows(df, [unit, by], variables)
    years, k = count_levels(data, [by])[0], len(zs)
    if not years:
        raise ValueError("no complete rows")
    if years > DENSE_LEVELS:
        raise ValueError(f"{by} has too many levels for unit slopes: {years}")
    levels = factor_levels(data, [by])
    shared = years + k
    size = shared + 1  # years, covariates, y
    # Residual variation of x at rounding level counts as none.
    sxx = F.when(F.col("s_1_1") > 1e-14 * F.col("raw_1"), F.col("s_1_1"))
    blocks = unit_blocks(number_levels(data, [by], levels), unit, variables).withColumn("sxx", sxx)
    # What x explains of the shared effects inside the unit; zero entries are left out.
    q = vector("entries", lambda e: e["dev_1"], [(years + i - 2, F.col(f"s_1_{i}")) for i in range(2, k + 2)])
    blocks = materialise(blocks.withColumn("q", F.filter(q, lambda e: e["v"] != 0)))

    pairs = pairs_of(variables)
    intercept = vector("entries", lambda e: e["c"] / F.sqrt("n"))
    slope = F.concat("q", F.array(F.struct(F.lit(shared).alias("k"), F.col("s_0_1").alias("v"))))
    slope = F.transform(slope, lambda e: F.struct(e["k"].alias("k"), (e["v"] / F.sqrt("sxx")).alias("v")))
    # A unit whose x does not vary has no slope vector.
    slope = F.when(F.col("sxx").isNotNull(), slope)
    outer, lines, total, ref = at_once(
        data, lambda: outer_sums(blocks, [intercept, slope], size), lambda: level_sums(blocks, ["c", *[f"dev_{i}" for i in range(k + 2)]], years),
        lambda: unit_sums(blocks.withColumn("varying", F.col("sxx").isNotNull().cast("long")),
                          ["n", "varying", *[f"s_{i}_{j}" for i, j in pairs], *[f"raw_{i}" for i in range(2, k + 2)]]),
        lambda: blocks.agg(F.min_by(F.struct(unit, "sxx", "q", "s_0_1"), unit).alias("ref")).first()["ref"])
    counts, cross = np.diag(lines[0]), lines[1:]

    # Product matrix of (years, zs, y) within units, then without what x explains inside each unit.
    g = np.zeros((size, size))
    g[:years, :years] = counts
    order = [*range(2, k + 2), 0]
    for a, i in enumerate(order):
        g[:years, years + a] = g[years + a, :years] = cross[i, :years]
        for b, j in enumerate(order):
            g[years + a, years + b] = total[f"s_{min(i, j)}_{max(i, j)}"]
    s = g - outer

    keep = list(range(1, shared))
    scale = np.diag(g)[:shared].copy()
    scale[years:] = variation_scale(scale[years:], np.array([total[f"raw_{i}"] for i in range(2, k + 2)]))
    gamma_k, inverse_k, rank = solve_normal(s[np.ix_(keep, keep)], s[keep, shared], scale[keep])
    gamma, inverse = np.zeros(shared), np.zeros((shared, shared))
    gamma[keep] = np.nan_to_num(gamma_k)
    inverse[np.ix_(keep, keep)] = np.nan_to_num(inverse_k)
    rss = max(s[shared, shared] - gamma @ s[:shared, shared], 0.0)
    df_resid = int(total["n"] - total["units"] - total["varying"] - rank)
    sigma2 = rss / df_resid if df_resid > 0 else float("nan")

    # Slopes, solved back per unit: beta = (sxy - q'gamma) / sxx, var = sigma2 (1 / sxx + q' inverse q / sxx^2).
    q_ref = np.zeros(shared)
    for e in ref["q"]:
        q_ref[e["k"]] = e["v"]
    ref_sxx = ref["sxx"]
    toward = inverse @ q_ref / ref_sxx if ref_sxx else np.zeros(shared)
    spark = df.sparkSession
    effects = spark.createDataFrame([(i, float(gamma[i]), float(toward[i])) for i in range(shared)], "k int, gamma double, toward double")
    at = np.argwhere(np.triu(inverse) != 0)
    spread = spark.createDataFrame(
        [(int(i), int(j), float(inverse[i, j] * (1 if i == j else 2))) for i, j in at], "i int, j int, share double")
    entries = blocks.where("sxx is not null").select(unit, "q", F.posexplode("q").alias("_at", "_a"))
    linear = entries.select(unit, F.col("_a.k").alias("k"), F.col("_a.v").alias("v")).join(effects, "k").groupBy(unit).agg(
        F.sum(F.col("v") * F.col("gamma")).alias("_gamma"), F.sum(F.col("v") * F.col("toward")).alias("_toward"))
    both = entries.select(unit, "_a", F.explode(F.slice("q", F.col("_at") + 1, F.size("q"))).alias("_b"))
    quadratic = both.select(unit, F.col("_a.k").alias("i"), F.col("_b.k").alias("j"), (F.col("_a.v") * F.col("_b.v")).alias("v")).join(
        spread, ["i", "j"]).groupBy(unit).agg(F.sum(F.col("v") * F.col("share")).alias("_quadratic"))
    joined = blocks.select(unit, "sxx", "s_0_1").join(linear, unit, "left").join(quadratic, unit, "left")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    sigma2_c = F.lit(float(sigma2))
    solved = joined.select(
        unit,
        ((F.col("s_0_1") - none("_gamma")) / F.col("sxx")).alias("slope"),
        (sigma2_c * (1 / F.col("sxx") + F.greatest(none("_quadratic"), F.lit(0.0)) / (F.col("sxx") * F.col("sxx")))).alias("_var"),
        (F.when(F.lit(ref_sxx is not None), sigma2_c * none("_toward") / F.col("sxx"))).alias("_cov"),
    )
    if ref_sxx:
        slope_ref = float((ref["s_0_1"] - q_ref @ gamma) / ref_sxx)
        var_ref = float(sigma2 * (1 / ref_sxx + q_ref @ inverse @ q_ref / ref_sxx ** 2))
    else:
        slope_ref = var_ref = None
    other = F.col(unit) != F.lit(ref[unit])
    solved = solved.withColumns({
        "std_error": F.sqrt("_var"),
        "slope_minus_ref": F.when(other, F.col("slope") - F.lit(slope_ref).cast("double")),
        "diff_std_error": F.when(other, F.sqrt(
            F.greatest(F.col("_var") + F.lit(var_ref).cast("double") - 2 * F.col("_cov"), F.lit(0.0)))),
    }).withColumns({
        "t_value": ratio(F.col("slope"), F.col("std_error")),
        "diff_t_value": ratio(F.col("slope_minus_ref"), F.col("diff_std_error")),
    })
    return solved.select(
        unit, "slope", "std_error", "t_value", two_sided_p_column(F.col("t_value"), df_resid).alias("p_value"),
        "slope_minus_ref", "diff_std_error", "diff_t_value",
        two_sided_p_column(F.col("diff_t_value"), df_resid).alias("diff_p_value"),
        F.lit(df_resid).cast("long").alias("df_resid"),
    )


def interaction_table(slopes: DataFrame, unit: str) -> DataFrame:
    """The interaction rows alone: one row per unit except the reference, estimate = difference to the reference."""
    return slopes.where(F.col("slope_minus_ref").isNotNull()).select(
        unit, F.col("slope_minus_ref").alias("estimate"), F.col("diff_std_error").alias("std_error"),
        F.col("diff_t_value").alias("t_value"), F.col("diff_p_value").alias("p_value"))
