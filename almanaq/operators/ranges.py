"""Joins that Spark would do as nested loops or as one hot task: values in ranges, and skewed keys (J4, J8, J12, A6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; there are fewer than ``1 / HOT_SHARE`` such keys.
HOT_SHARE = 1 / 256


def _width(lo: str, hi: str) -> Column:
    """Exponent of the smallest power of two that is no shorter than the range."""
    length = F.col(hi) - F.col(lo) + 1
    bits = F.length(F.conv(F.hex(length - 1), 16, 2))
    return F.when(length <= 1, F.lit(0)).otherwise(bits)


def range_join(facts: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, on: Sequence[str] = ()) -> DataFrame:
    """Every row of ``facts`` with every row of ``ranges`` whose ``lo <= value <= hi`` holds it (whole numbers, both ends in).

    A range is put into buckets as wide as itself (the next power of two), at most two of them; a fact goes to one bucket
    of each width that occurs, so it is repeated as often as there are different widths, not ranges. Buckets meet by
    equality, the exact test follows. ``on`` names further columns that must be equal. NULL or empty ranges and NULL
    values meet nothing. Names of the two sides must differ, but for ``on``.
    """
    known = ranges.where((F.col(lo) <= F.col(hi))).withColumns({lo: F.col(lo).cast("long"), hi: F.col(hi).cast("long")})
    known = known.withColumn("_width", _width(lo, hi).cast("int"))
    down = lambda c: F.call_function("shiftright", c, F.col("_width"))
    placed = known.withColumn("_bucket", F.explode(F.sequence(down(F.col(lo)), down(F.col(hi)))))
    widths = sorted(row["_width"] for row in known.select("_width").distinct().collect())  # at most 64
    spread = facts.where(F.col(value).isNotNull()).withColumn("_width", F.explode(F.lit(widths).cast("array<int>")))
    spread = spread.withColumn("_bucket", down(F.col(value).cast("long")))
    right = placed.withColumnsRenamed({k: f"_right_{k}" for k in ("_width", "_bucket", *on)})
    match = [F.col(k) == F.col(f"_right_{k}") for k in ("_width", "_bucket", *on)]
    inside = F.col(value).between(F.col(lo), F.col(hi))
    joined = spread.join(right, [*match, inside])
    return joined.drop("_width", "_bucket", *[f"_right_{k}" for k in ("_width", "_bucket", *on)])


def hot_keys(facts: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """``_hot``: the keys with more than ``share`` of all rows, NULL among them, counted exactly.

    Counts are added up map-side, so a hot key is one row a task; what is returned has fewer than ``1 / share`` rows.
    """
    counted = facts.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.sum("_n").alias("_total"))
    return counted.crossJoin(F.broadcast(total)).where(F.col("_n") > share * F.col("_total")).select("_hot")


def skewed_lookup_join(
        facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str = "left", salts: int = 64, share: float = HOT_SHARE) -> DataFrame:
    """``panel.lookup_join`` for facts with hot keys: NULL matches NULL, a lookup row may match many facts and the reverse.

    Rows of hot keys are dealt over ``salts`` parts by a hash of the whole row, and the lookup's rows of these keys are
    repeated for every part; all other rows join plainly. Which keys are hot is counted, not sampled, and told to both
    sides as a table of fewer than ``1 / share`` rows.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"only left and inner lookups can be dealt, not {how}")
    attributes = [c for c in dim.columns if c != dim_key]
    dim = dim.select(F.col(dim_key).alias("_lookup_key"), *attributes)
    hot = F.broadcast(hot_keys(facts, fact_key, share).withColumn("_is_hot", F.lit(True)))
    dealt = facts.join(hot, F.col(fact_key).eqNullSafe(F.col("_hot")), "left").drop("_hot")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(salts)).cast("int")
    dealt = dealt.withColumn("_salt", F.when(F.col("_is_hot"), part).otherwise(F.lit(-1))).drop("_is_hot")
    spread = dim.join(hot, F.col("_lookup_key").eqNullSafe(F.col("_hot")), "left").drop("_hot")
    all_parts = F.sequence(F.lit(0), F.lit(salts - 1))
    spread = spread.withColumn("_part", F.explode(F.when(F.col("_is_hot"), all_parts).otherwise(F.array(F.lit(-1))))).drop("_is_hot")
    match = F.col(fact_key).eqNullSafe(F.col("_lookup_key")) & (F.col("_salt") == F.col("_part"))
    return dealt.join(spread, match, how).drop("_lookup_key", "_salt", "_part")
