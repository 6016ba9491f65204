"""Saved results and shared intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session, which all executors must share.

    Where it is unset, a local-mode session (tests, a single machine) gets a folder below its warehouse; on a cluster the
    setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and returns the table read back.

    Used where one result feeds several jobs: the raw facts are scanned once, the lineage ends here, later jobs prune
    columns, and a lost executor costs no recomputation of the facts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/almanaq-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._almanaq_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` returned, once nothing will read them any more; a second call does nothing."""
    for df in tables:
        path = df.__dict__.pop("_almanaq_path", None)
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise_all(*dfs: DataFrame) -> list[DataFrame]:
    """``materialise`` for several independent tables, as concurrent Spark jobs."""
    with ThreadPoolExecutor(len(dfs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(df.sparkSession)(materialise), df) for df in dfs]]


def write_table(df: DataFrame, path: str) -> None:
    """Saves coefficients, dissolved polygons or the rows behind a figure."""
    df.write.mode("overwrite").parquet(path)


def write_results(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Saves every table of an analysis, coefficients and rows behind figures alike, as ``folder/name``."""
    for name, df in tables.items():
        write_table(df, f"{folder.rstrip('/')}/{name}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Reloads a saved table."""
    return spark.read.parquet(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Vertex table ``(unit, ring, seq, lon, lat)`` plus attributes."""
    return spark.read.parquet(path)
