"""CSV scans with fixed schemas."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanaq.functions.scalar import null_if_nan
from almanaq.operators.reshape import unpivot_matching

_FLOATS = (T.DoubleType, T.FloatType)


def _nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, _FLOATS)]
    return df.withColumns({c: null_if_nan(F.col(f"`{c}`")) for c in floats}) if floats else df


def read_parts(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, encoding: str = "UTF-8", multiline: bool = True,
) -> DataFrame:
    """Several CSV files with one header and schema, stacked in one scan. ``NA``, empty and NaN fields become NULL.

    Quoted fields may hold commas, doubled quotes and line breaks. Files with line breaks inside fields can't be split:
    pass ``multiline=False`` for large files without any, numeric tables say.
    ``encoding="ISO-8859-1"`` reads legacy files one byte per character; see ``text.decode_codepage`` for DOS pages.
    """
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "NA")
        .option("encoding", encoding)
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("multiLine", multiline)
    )
    return _nan_to_null(reader.csv(list(paths)))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", multiline: bool = True,
) -> DataFrame:
    """One CSV file with a header."""
    return read_parts(spark, [path], schema, encoding, multiline)


def legal_name(name: str) -> str:
    """Header text as a legal name: odd characters to dots, ``X`` before a leading digit or dot-digit or symbol."""
    clean = re.sub(r"[^\w.]", ".", name)
    starts_ok = re.match(r"^([^\W\d_]|\.(?!\d))", clean) and not re.match(r"^[^\w.]", name)
    return clean if starts_ok else "X" + clean


def unique_names(header: Sequence[str]) -> list[str]:
    """Legal names for a header; repeats get ``.1``, ``.2``, ..., skipping names that the header has itself."""
    legal = [legal_name(name) for name in header]
    taken: set[str] = set()
    names = []
    for name in legal:
        fresh, n = name, 0
        while fresh in taken or (n and fresh in legal):
            n += 1
            fresh = f"{name}.{n}"
        taken.add(fresh)
        names.append(fresh)
    return names


def make_names(df: DataFrame) -> DataFrame:
    """Renames every column to a legal, unique name (``1950-01`` to ``X1950.01``, ``#date`` to ``X.date``)."""
    return df.toDF(*unique_names(df.columns))


def read_header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of a CSV file; only its first line is read."""
    row = spark.read.option("escape", '"').option("encoding", encoding).csv(path).first()
    return ["" if name is None else name for name in row] if row else []


def file_headers(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8") -> dict[str, list[str]]:
    """Column names of every file that paths, folders and globs name; files without a line are left out.

    One query over all files, however many: lines are not parsed. Their numbers are scanned for the first one of every
    file, then the lines for those of that number. An aggregate that carried lines would sort all of a task's first.
    A row per file reaches the driver, which needs their names for the scans anyway.
    """
    lines = spark.read.text(list(paths)).where(F.col("value").rlike("[^\\x00-\\x20]"))
    found = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    first = found.where("start = 0").groupBy(F.col("path").alias("file")).agg(F.min("at").alias("first"))
    headers = found.join(F.broadcast(first), (F.col("at") == F.col("first")) & (F.col("path") == F.col("file")))
    rows = headers.select("path", F.col("value").cast("binary").alias("line")).collect()
    return {unquote(row["path"]): next(csv.reader([row["line"].decode(encoding, "replace").removeprefix("\ufeff")])) for row in sorted(rows, key=lambda row: row["path"])}


def _scans(
    spark: SparkSession, paths: Sequence[str], types: Mapping[str, T.DataType], encoding: str, multiline: bool, *extra: str,
) -> DataFrame:
    """The named columns of all files, stacked by name; a scan per distinct header."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path, header in file_headers(spark, paths, encoding).items():
        by_header.setdefault(tuple(header), []).append(path)
    parts = []
    for header, same in by_header.items():
        schema = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in unique_names(header)])
        parts.append(read_parts(spark, same, schema, encoding, multiline).select(*[F.col(f"`{c}`") for c in types], *extra))
    if not parts:
        raise ValueError(f"no CSV file with a header in {list(paths)}")
    return reduce(DataFrame.unionByName, parts)


def read_named(
    spark: SparkSession, paths: Sequence[str], types: Mapping[str, T.DataType], encoding: str = "UTF-8", multiline: bool = True,
) -> DataFrame:
    """The named columns of CSV files, folders or globs, with given types and legal names; other columns are not parsed.

    Every file's own header counts, also inside a folder: files with the same header are one scan, files whose columns
    are in another order are stacked by name. Cells that are not of their type become NULL; ``bad_cells`` counts them.
    """
    return _scans(spark, paths, types, encoding, multiline)


def bad_cells(
    spark: SparkSession, paths: Sequence[str], types: Mapping[str, T.DataType], encoding: str = "UTF-8", multiline: bool = True,
) -> DataFrame:
    """``file, column, cells, bad, example``: of every file (its address) and typed column, how many cells are given, and how many of
    these ``read_named`` turns into NULL because they are not of the column's type, with the smallest one of them.

    A cell counts as bad when the CSV parser itself, given that cell alone, finds no value. Under a strict sum one such
    cell blanks its whole group.
    """
    typed = {c: t for c, t in types.items() if not isinstance(t, T.StringType)}
    raw = _scans(spark, paths, {c: T.StringType() for c in typed}, encoding, multiline, "_metadata.file_path")
    options = {"escape": '"', "nullValue": "NA", "mode": "PERMISSIVE"}
    cells = []
    for c, kind in typed.items():
        alone = F.to_csv(F.struct(F.col(f"`{c}`").alias("cell")), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
        value = F.from_csv(alone, f"cell {kind.simpleString()}", options)["cell"]
        cells.append(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("raw"), (F.col(f"`{c}`").isNotNull() & value.isNull()).alias("bad")))
    flat = raw.select(F.col("file_path").alias("file"), F.explode(F.array(*cells)).alias("_c"))
    return flat.groupBy("file", F.col("_c.column").alias("column")).agg(
        F.count("_c.raw").alias("cells"), F.count_if(F.col("_c.bad")).alias("bad"), F.min(F.when(F.col("_c.bad"), F.col("_c.raw"))).alias("example"))


def read_wide_series(
    spark: SparkSession, path: str, ids: Sequence[str], value: str = "value", encoding: str = "UTF-8", multiline: bool = False,
) -> DataFrame:
    """A table with one ``YYYY-MM`` column per month as rows ``(ids, year, month, value)``.

    Such tables are numbers, so files are split; pass ``multiline=True`` where an id holds a line break.
    """
    header = read_header(spark, path, encoding)
    schema = T.StructType([T.StructField(c, T.StringType() if c in ids else T.DoubleType()) for c in header])
    return unpivot_matching(make_names(read_csv(spark, path, schema, encoding, multiline)), ids, value=value)
