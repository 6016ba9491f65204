"""Wide to long, and completed year-month grids."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanaq.fixed import MONTH_COLUMN_PATTERN, SPANISH_MONTHS


def _long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], labels: Mapping[str, Sequence], value: str) -> DataFrame:
    """One row per id and column, with fixed labels per column in place of its name.

    An array spread inside the scan: unlike one projection per column it stays compact for hundreds of columns, and
    names are parsed once, not per row.
    """
    cells = F.posexplode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("_at", value)
    named = [F.get(F.array(*[F.lit(v) for v in values]), F.col("_at")).alias(name) for name, values in labels.items()]
    return df.select(*[F.col(f"`{c}`") for c in ids], cells).select(*[F.col(f"`{c}`") for c in ids], *named, value)


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    at = df.columns.index(first)
    return df.columns[at:df.columns.index(last) + 1]


def unpivot_matching(
    df: DataFrame, ids: Sequence[str], pattern: str = MONTH_COLUMN_PATTERN, value: str = "value",
) -> DataFrame:
    """One row per month from columns named ``XYYYY.MM`` (or any pattern with year in 1-4 and month in 6-7)."""
    columns = columns_matching(df, pattern)
    dates = [re.sub("^X", "", c).replace(".", "-") for c in columns]
    return _long(df, ids, columns, {"year": [int(d[:4]) for d in dates], "month": [int(d[5:7]) for d in dates]}, value)


def unpivot_between(
    df: DataFrame, ids: Sequence[str], first: str, last: str, value: str = "value", names: Sequence[str] = SPANISH_MONTHS,
) -> DataFrame:
    """One row per month from the columns ``first`` to ``last``, whose names are month names."""
    columns = columns_between(df, first, last)
    month = {n.upper(): i for i, n in enumerate(names, 1)}
    return _long(df, ids, columns, {"month": [month.get(c.strip().upper()) for c in columns]}, value)


def complete_grid(df: DataFrame, value: str, years: tuple[int, int], default: int | float = 0) -> DataFrame:
    """Adds the missing cells of ``years`` x 1..12 with a default; rows outside the grid are kept.

    NULL values become the default as well. ``df`` has one row per (year, month).
    """
    grid = df.sparkSession.range(years[0], years[1] + 1).select(
        F.col("id").cast("int").alias("year"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return (
        df.join(grid, ["year", "month"], "full")
        .withColumn(value, F.coalesce(value, F.lit(default).cast(df.schema[value].dataType)))
    )
