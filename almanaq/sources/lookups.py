"""Lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which an inline lookup is sent to every executor.
BROADCAST_ROWS = 10_000


def lookup(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Inline lookup table, broadcast when its counted rows are few; otherwise the join strategy is left to Spark."""
    df = spark.createDataFrame(list(rows), list(columns))
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df
