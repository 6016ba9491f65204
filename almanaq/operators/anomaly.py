"""Anomalies: z-scores, deviations from a mean, and their composition.

The grouping is always an explicit argument. Statistics are aggregated (map-side first) and joined back, whatever the
keys are called: few groups make a small table, which Spark broadcasts by its own size check; many groups make a join on
the keys, whose hot ones adaptive execution splits. No window pulls a group into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanaq.functions.calendar import month_start
from almanaq.functions.scalar import above_below, ratio

def attach(df: DataFrame, by: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Adds group statistics to every row; NULL keys form a group of their own."""
    renamed = [F.col(k).alias(f"_by_{k}") for k in by]
    table = df.groupBy(*renamed).agg(*[c.alias(n) for n, c in stats.items()])
    if not by:
        return df.crossJoin(F.broadcast(table))  # one row
    match = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by]
    return df.join(table, match, "left").drop(*[f"_by_{k}" for k in by])


def zscore(df: DataFrame, columns: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """Adds ``(x - mean) / sd`` per group for each ``{output: input}``, with the n-1 standard deviation.

    ``by=[]`` standardises over the whole table. NULL where the group has no spread or a single row.
    """
    stats = {}
    for out, col in columns.items():
        stats[f"_mean_{out}"] = F.avg(col)
        stats[f"_sd_{out}"] = F.stddev_samp(col)
    scored = {out: ratio(F.col(col) - F.col(f"_mean_{out}"), F.col(f"_sd_{out}")) for out, col in columns.items()}
    return attach(df, by, stats).withColumns(scored).drop(*stats)


def deviation(
    df: DataFrame, col: str, by: Sequence[str], mean: str | None = None, out: str = "deviation", flag: str | None = None,
) -> DataFrame:
    """Adds the group mean of ``col`` (as ``mean``), the deviation from it, and optionally its direction flag."""
    mean = mean or f"mean_{col}"
    result = attach(df, by, {mean: F.avg(col)}).withColumn(out, F.col(col) - F.col(mean))
    return result.withColumn(flag, above_below(out)) if flag else result


def standardised_deviation(
    df: DataFrame, col: str, within: Sequence[str], by: Sequence[str], out: str = "deviation",
) -> DataFrame:
    """Standardises ``col`` within ``within``, then removes the mean of the result by ``by``."""
    z = f"standardized_{col}"
    return deviation(zscore(df, {z: col}, within), z, by, mean=f"mean_{z}", out=out)


def period_index(df: DataFrame, date: str = "date", out: str = "time") -> DataFrame:
    """Adds the month's date and its dense rank among the dates that occur (1 = first).

    Only the distinct month dates are ranked (at most twelve a year); the ranks are broadcast back.
    """
    dated = df.withColumn(date, month_start("year", "month"))
    ranks = dated.agg(F.array_sort(F.collect_set(date)).alias("_dates")).select(
        F.posexplode("_dates").alias("_at", "_date")).select("_date", (F.col("_at") + 1).alias(out))
    return dated.join(F.broadcast(ranks), F.col(date).eqNullSafe(F.col("_date")), "left").drop("_date")
