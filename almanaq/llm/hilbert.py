"""Sharding along a Hilbert curve: quantised metadata, sorted by curve index, cut into runs of equal row counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BITS = 4  # cells per dimension: 2**BITS; the grid of three dimensions has 4096 cells


def hilbert_index(dims: Sequence[Column], bits: int = BITS) -> Column:
    """Curve index of a cell; each dimension is an integer from 0 to ``2**bits - 1``.

    Level by level, from the highest bit: the octant is turned into the frame of the current sub-cube (entry corner and
    direction), its place along the Gray code is the next digit, and the frame of that octant follows.
    """
    n = len(dims)
    full = (1 << n) - 1

    def gray(i):
        return i ^ (i >> 1)

    place = [0] * (1 << n)
    for i in range(1 << n):
        place[gray(i)] = i

    def trailing_ones(i):
        return (~i & (i + 1)).bit_length() - 1

    entry = [0 if i == 0 else gray(2 * ((i - 1) // 2)) for i in range(1 << n)]
    turn = [0 if i == 0 else trailing_ones(i - 1 if i % 2 == 0 else i) % n for i in range(1 << n)]

    def lookup(values, at):
        return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)

    def rotate(values, bits_):  # every rotation of every value, as one table
        return [((v << bits_) | (v >> (n - bits_))) & full if bits_ else v for v in values]

    left = [v for k in range(n) for v in rotate(range(1 << n), k)]
    right = [v for k in range(n) for v in rotate(range(1 << n), (n - k) % n)]

    def step(acc, level):
        octant = F.lit(0)
        for j, d in enumerate(dims):
            octant = octant.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", d, level).bitwiseAND(F.lit(1)), F.lit(j)))
        spin = (acc["dir"] + 1) % n
        digit = lookup(place, lookup(right, spin * (1 << n) + octant.bitwiseXOR(acc["entry"])))
        return F.struct(
            (acc["h"] * (1 << n) + digit).cast("long").alias("h"), digit.cast("int").alias("digit"),
            acc["entry"].cast("int").alias("entry"), acc["dir"].cast("int").alias("dir"))

    def follow(acc):
        spin = (acc["dir"] + 1) % n
        return F.struct(
            acc["h"].alias("h"), acc["digit"].alias("digit"),
            acc["entry"].bitwiseXOR(lookup(left, spin * (1 << n) + lookup(entry, acc["digit"]))).cast("int").alias("entry"),
            ((acc["dir"] + lookup(turn, acc["digit"]) + 1) % n).cast("int").alias("dir"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("digit"), F.lit(0).alias("entry"), F.lit(0).alias("dir"))
    # two steps a level (digit, then frame), so that no expression is repeated inside another
    steps = F.array(*[F.lit(s) for level in reversed(range(bits)) for s in (2 * level, 2 * level + 1)])
    return F.aggregate(
        steps, start,
        lambda acc, s: F.when(s % 2 == 0, step(acc, (s / 2).cast("int"))).otherwise(follow(acc)), lambda acc: acc["h"])


def default_dims(lang: Column, source: Column, size: Column) -> list[Column]:
    """Language and source by hash, size by its logarithm; null has a cell of its own (0)."""
    by_name = [F.when(c.isNull(), F.lit(0)).otherwise(1 + F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit((1 << BITS) - 1))) for c in (lang, source)]
    by_size = F.least(F.greatest(F.floor(F.log2(size)) - 4, F.lit(0)), F.lit((1 << BITS) - 1))
    return [c.cast("int") for c in [*by_name, by_size]]


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_sum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def hilbert_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve`` per row of ``docs``; law ``rows``.

    Rows are ranked along the curve, within a cell by a hash of the id and then the id and the text's checksum; shard
    ``floor(rank * n_shards / rows)``, so counts differ by one at most and neighbours on the curve share a shard. A null
    text has size 1, a null id comes first. Rows equal in id and text take neighbouring ranks. Missing ``lang`` or
    ``source`` columns count as null; other columns are not read.

    Ranks come from three sums: rows before the cell (one row per cell of the grid), before the bin of the cell, and
    within the bin. A cell has so many bins that each holds about the square root of all rows, also in a hot cell.
    """
    text = F.col(text_col)
    raw = docs.select(
        F.col(id_col).alias("doc_id"), text_size(text).alias("size"),
        text_sum(text).alias("text_crc32"),
        _column(docs, "lang").alias("lang"), _column(docs, "source").alias("source"))
    cells = materialise(
        raw.withColumns({f"d{i}": c for i, c in enumerate(default_dims(F.col("lang"), F.col("source"), F.col("size")))})
        .select("doc_id", "size", "text_crc32", hilbert_index([F.col(f"d{i}") for i in range(3)]).alias("curve")))
    # a sparse grid of at most 4096 rows: one small window without a key
    totals = materialise(cells.groupBy("curve").agg(F.count(F.lit(1)).alias("n")))
    n = totals.agg(F.sum("n")).first()[0] or 0
    per_bin = max(256, math.isqrt(n))
    before = totals.select(
        "curve", F.ceil(F.col("n") / per_bin).alias("bins"),
        (F.sum("n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("cell_base"))
    binned = cells.join(F.broadcast(before), "curve").withColumn(
        "bin", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("bins")))
    bins = binned.groupBy("curve", "bin").agg(F.count(F.lit(1)).alias("n"))
    in_cell = Window.partitionBy("curve").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = bins.select("curve", "bin", (F.sum("n").over(in_cell) - F.col("n")).alias("bin_base"))
    in_bin = Window.partitionBy("curve", "bin").orderBy("doc_id", "text_crc32", "size")
    ranked = binned.withColumn("in_bin", F.row_number().over(in_bin)).join(bases, ["curve", "bin"])
    rank = F.col("cell_base") + F.col("bin_base") + F.col("in_bin") - 1
    shard = F.expr(f"(rank * {n_shards}L) div {max(n, 1)}L")
    # a shard's first rank: the smallest r with r * n_shards >= shard * n
    return (
        ranked.withColumn("rank", rank.cast("long")).withColumn("shard", shard)
        .withColumn("slot", (F.col("rank") - F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                F.lit(None).cast("int").alias("grown_shard"), "curve"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every row of ``docs`` once as Parquet, one folder per shard, files sorted along the curve for pruning.

    ``placed`` is ``hilbert_shards`` of the same rows. A row takes the place of its id (null too), text size, checksum and
    cell; rows equal in these are numbered on both sides, so each takes a place of its own.
    """
    key = ["__id", "__size", "__crc", "__curve"]
    number = F.row_number().over(Window.partitionBy(*key).orderBy("__order"))
    text = F.col(text_col)
    rows = docs.withColumns({
        "__id": F.col(id_col), "__size": text_size(text), "__crc": text_sum(text),
        "__order": F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])})
    rows = rows.withColumns({f"__d{i}": c for i, c in enumerate(default_dims(_column(docs, "lang"), _column(docs, "source"), F.col("__size")))})
    rows = rows.withColumn("__curve", hilbert_index([F.col(f"__d{i}") for i in range(3)])).withColumn("__number", number)
    place = placed.select(
        F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), F.col("curve").alias("__curve"),
        F.struct("shard", "slot").alias("__order"), "shard", "slot", "curve").withColumn("__number", number)
    left, right = rows.alias("l"), place.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*key, "__number"]]
    (left.join(right, same).select(*[F.col(f"l.{c}") for c in docs.columns], "r.shard", "r.slot", "r.curve")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
