"""Shared small parts: the documents table and the package on the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

import almanaq
from almanaq.sources.tables import materialise, shared_dir

__all__ = ["documents", "materialise", "ship_package", "shared_dir"]

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers wherever the driver was started (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(almanaq.__file__))
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    with tempfile.NamedTemporaryFile(prefix="almanaq-", suffix=".zip", delete=False) as f:
        f.write(blob.getvalue())
    spark.sparkContext.addPyFile(f.name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
