"""Exact quantiles of groups of any size, without sorting or holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanaq.sources.tables import discard, materialise

BUCKETS = 1024


def exact_quantiles(df: DataFrame, x: str, count: str, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``by, q``: for each group of ``by`` the quantiles of ``x`` at ``probs``, interpolated between neighbours, as an array.

    ``x`` is a double and each row counts ``count`` times; NULL and NaN don't occur. Every order statistic that is needed
    has a range of values that holds it. A pass counts the rows in equal parts of all ranges at once and keeps the part
    that holds the statistic, from its smallest to its largest value, until these are the same. A pass divides a range by
    up to ``BUCKETS``, and at least parts its ends.
    """
    keys = [f"_by_{k}" for k in by]
    rows = df.select(*[F.col(k).alias(f"_by_{k}") for k in by], F.col(x).alias("_x"), F.col(count).alias("_c"))
    whole = rows.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    place = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in probs])))
    targets = materialise(whole.select(*keys, "_n", F.explode(wanted).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")))
    match = [F.col(k).eqNullSafe(F.col(f"_t{k}")) for k in keys]
    while not targets.where("lo < hi").isEmpty():
        open_ = targets.where("lo < hi").select(*[F.col(k).alias(f"_t{k}") for k in keys], "rank", "lo", "hi", "below")
        inside = rows.join(open_, [*match, F.col("_x").between(F.col("lo"), F.col("hi"))]) if keys else rows.join(open_, F.col("_x").between(F.col("lo"), F.col("hi")))
        share = (F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: the span may not overflow
        part = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        parts = inside.withColumn("_part", F.when(F.col("_x") == F.col("hi"), BUCKETS).otherwise(part)).groupBy(*keys, "rank", "below", "_part").agg(
            F.sum("_c").alias("_n_part"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        # at most BUCKETS + 1 rows a statistic
        along = Window.partitionBy(*keys, "rank").orderBy("_part")
        before = F.coalesce(F.sum("_n_part").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
        chosen = parts.withColumn("_before", before).where((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("_n_part")))
        narrowed = chosen.select(*[F.col(k).alias(f"_t{k}") for k in keys], F.col("rank").alias("_rank"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "_before")
        on = [*match, F.col("rank") == F.col("_rank")]
        after = materialise(targets.join(narrowed, on, "left").select(
            *keys, "_n", "rank", F.coalesce("_lo", "lo").alias("lo"), F.coalesce("_hi", "hi").alias("hi"), F.coalesce("_before", "below").alias("below")))
        discard(targets)
        targets = after
    found = targets.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("_at"))  # two entries a quantile

    def between(p: float):
        low, high = F.element_at("_at", F.floor(place(p))), F.element_at("_at", F.ceil(place(p)))
        rest = place(p) - F.floor(place(p))
        return F.when(rest == 0, low).otherwise((1 - rest) * low + rest * high)

    return found.select(*[F.col(f"_by_{k}").alias(k) for k in by], F.array(*[between(p) for p in probs]).alias("q"))
