"""Panels: merging, zero filling, splicing, audits, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanaq.functions.text import fold_key

CELL = ("year", "month")


def merge(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins two tables on equal keys, NULL matching NULL; other columns must have different names."""
    shared = (set(left.columns) & set(right.columns)) - set(on)
    if shared:
        raise ValueError(f"rename before merging: {sorted(shared)}")
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    match = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in on]
    joined = left.join(right, match, how)
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"_right_{k}")) for k in on})
    return joined.drop(*[f"_right_{k}" for k in on])


def lookup_join(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, fold: bool = False, how: str = "left") -> DataFrame:
    """Left join with a lookup whose key has another name; its key column is dropped.

    ``fold=True`` compares folded keys (see ``text.fold_key``). A lookup row may match many facts and the reverse, so
    this is also the fan-out from a lookup to a series.
    """
    shape = fold_key if fold else F.col
    attributes = [F.col(c) for c in dim.columns if c != dim_key]
    dim = dim.select(shape(dim_key).alias("_lookup_key"), *attributes)
    return facts.join(dim, shape(fact_key).eqNullSafe(F.col("_lookup_key")), how).drop("_lookup_key")


def unmatched_keys(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Keys of the facts that the lookup lacks, with their row counts.

    The facts are counted per key before the anti join, so a hot key is one row.
    """
    counted = facts.groupBy(fact_key).agg(F.count(F.lit(1)).alias("rows"))
    known = dim.select(F.col(dim_key).alias("_known"))
    return counted.join(known, F.col(fact_key).eqNullSafe(F.col("_known")), "left_anti")


def skeleton_fill(skeleton: DataFrame, facts: DataFrame, keys: Sequence[str], value: str, fill: int | float = 0) -> DataFrame:
    """All key combinations of ``skeleton``, with the facts' value or ``fill``. NULL keys match NULL keys."""
    filled = merge(skeleton.select(*keys), facts.select(*keys, value), keys, "left")
    return filled.withColumn(value, F.coalesce(value, F.lit(fill).cast(facts.schema[value].dataType)))


def splice(old: DataFrame, new: DataFrame, cut: int) -> DataFrame:
    """Stacks two sources of one series: ``old`` before the cut year, all of ``new``."""
    return old.where(F.col("year") < cut).unionByName(new)


def _matching_periods(periods: Sequence[tuple[str, int, int]]) -> Column:
    table = F.array(*[
        F.struct(F.lit(i).alias("period_ord"), F.lit(name).alias("period"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        for i, (name, lo, hi) in enumerate(periods, 1)
    ])
    return F.filter(table, lambda p: F.col("year").between(p["lo"], p["hi"]))


def period_profile(
    df: DataFrame, periods: Sequence[tuple[str, int, int]], value: str, out: str | None = None, by: Sequence[str] = ("month",),
) -> DataFrame:
    """Mean of ``value`` by labelled year range and month.

    Ranges may overlap; each row is spread to the ranges that hold its year inside the scan, so there is one pass for
    all periods and no range join.
    """
    spread = df.withColumn("_period", F.explode(_matching_periods(periods)))
    return (
        spread.groupBy(F.col("_period.period_ord").alias("period_ord"), F.col("_period.period").alias("period"), *by)
        .agg(F.avg(value).alias(out or f"mean_{value}"))
    )


def recent_profile(
    df: DataFrame, unit: str, years: tuple[int, int], means: Mapping[str, str],
) -> DataFrame:
    """Several means per unit and month over the years ``years[0] <= year < years[1]``, in one pass."""
    window = (F.col("year") >= years[0]) & (F.col("year") < years[1])
    return df.where(window).groupBy(unit, "month").agg(*[F.avg(c).alias(n) for n, c in means.items()])
