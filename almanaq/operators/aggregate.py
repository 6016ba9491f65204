"""Monthly roll-ups.

Facts are reduced to (unit, year, month) cells first; everything later works on cells. All aggregates have a map-side
part, so one hot key never lands in one task as raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanaq.functions.scalar import skip_sum, strict_sum

YEAR_MONTH = ("year", "month")


def monthly(df: DataFrame, value: str | None, keys: Sequence[str] = YEAR_MONTH, na: str = "strict", out: str | None = None) -> DataFrame:
    """One row per key.

    ``na="strict"``: NULL as soon as one value is NULL. ``"skip"``: NULLs ignored, 0 when none is left. ``"mean"``:
    mean of the non-NULL values. ``"count"``: number of rows.
    """
    rules = {"strict": strict_sum, "skip": skip_sum, "mean": F.avg}
    total = F.count(F.lit(1)) if na == "count" else rules[na](value)
    return df.groupBy(*keys).agg(total.alias(out or value))


def _partials(measures: Mapping[str, tuple[str, str | None]]) -> list[Column]:
    parts = [F.count(F.lit(1)).alias("_rows")]
    for name, (_, value) in measures.items():
        if value is not None:
            parts += [F.sum(value).alias(f"_sum_{name}"), F.count(value).alias(f"_count_{name}")]
    return parts


def _finals(measures: Mapping[str, tuple[str, str | None]]) -> list[Column]:
    out = []
    for name, (na, _) in measures.items():
        total, present, rows = F.sum(f"_sum_{name}"), F.sum(f"_count_{name}"), F.sum("_rows")
        if na == "strict":
            c = F.when(present == rows, total)
        elif na == "skip":
            c = F.coalesce(total, F.lit(0))
        elif na == "mean":
            c = total / F.nullif(present, F.lit(0))
        elif na == "count":
            c = rows
        else:
            raise ValueError(f"unknown rule {na}")
        out.append(c.alias(name))
    return out


def monthly_through_lookup(
    facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, unit: str,
    measures: Mapping[str, tuple[str, str | None]], how: str = "left",
) -> DataFrame:
    """Cells (unit, year, month) of facts whose unit comes from a dimension table.

    The facts are summed per (fact key, year, month) before the join and again per unit after it. So a fact key that
    holds a third of all rows joins as a few rows per year, and the raw rows are never shuffled. ``measures`` maps an
    output name to (rule, column) with the rules of ``monthly``. NULL keys match NULL keys.
    """
    cells = facts.groupBy(fact_key, *YEAR_MONTH).agg(*_partials(measures))
    units = dim.select(F.col(dim_key).alias("_dim_key"), F.col(unit).alias("_unit"))
    joined = cells.join(units, F.col(fact_key).eqNullSafe(F.col("_dim_key")), how)
    return joined.groupBy(F.col("_unit").alias(unit), *YEAR_MONTH).agg(*_finals(measures))


def levels(facts: DataFrame, value: str, unit: str, parent: str, na: str = "strict") -> DataFrame:
    """Totals of one fact for every unit, every parent and overall, by year and month.

    ``level`` is ``unit``, ``parent`` or ``total``. The facts are read and shuffled once, at unit level; the upper
    levels are grouping sets over those cells.
    """
    measures = {value: (na, value)}
    cells = facts.groupBy(unit, parent, *YEAR_MONTH).agg(*_partials(measures))
    year, month = F.col("year"), F.col("month")
    sets = [[year, month], [year, month, F.col(parent)], [year, month, F.col(parent), F.col(unit)]]
    level = F.when(F.grouping(unit) == 0, "unit").when(F.grouping(parent) == 0, "parent").otherwise("total")
    return (
        cells.groupingSets(sets, year, month, F.col(parent), F.col(unit))
        .agg(level.alias("level"), *_finals(measures))
        .select("level", parent, unit, "year", "month", value)
    )
