"""Exact dedup: counting quotient filters per partition, merged by sorted remainders, then byte verification.

A text's 64-bit fingerprint is split into a quotient (its high bits, the slot) and a remainder. Each partition builds
counting quotient filters: for every range of quotients the occupied slots as a bit map, the run lengths, the
remainders in sorted order and their counts. Filters of one range merge without loss by merging their sorted
remainders and adding counts. Fingerprints counted once belong to unique texts; the others are routed to a
comparison of the normalised bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship_package

SLOT_BITS = 16  # quotient bits within one filter
_FILTER = "range long, slots binary, runs binary, remainders binary, counts binary"


def build_filter(fp: np.ndarray, range_bits: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Counting quotient filters of unsigned fingerprints, one per range (the top ``range_bits`` bits)."""
    values, counts = np.unique(fp, return_counts=True)
    yield from encode_filter(values, counts, range_bits)


def encode_filter(values: np.ndarray, counts: np.ndarray, range_bits: int):
    """``values`` sorted and distinct. A filter: occupied slots (bit map), run lengths, sorted remainders, counts."""
    U = np.uint64
    ranges = values >> U(64 - range_bits) if range_bits else np.zeros(len(values), U)
    for r in np.unique(ranges):
        lo, hi = np.searchsorted(ranges, r), np.searchsorted(ranges, r, "right")
        v, c = values[lo:hi], counts[lo:hi]
        rest = 64 - range_bits - SLOT_BITS
        slot = (v >> U(rest)) & U((1 << SLOT_BITS) - 1)
        used, runs = np.unique(slot, return_counts=True)
        occupied = np.zeros(1 << SLOT_BITS, np.uint8)
        occupied[used.astype(np.int64)] = 1
        # few slots: their numbers are shorter than the bit map
        slots = used.astype(np.uint16).tobytes() if 16 * len(used) < 1 << SLOT_BITS else b"B" + np.packbits(occupied).tobytes()
        yield int(r), slots, runs.astype(np.uint32).tobytes(), (v & U((1 << rest) - 1)).tobytes(), c.astype(np.uint64).tobytes()


def decode_filter(r: int, slots: bytes, runs: bytes, remainders: bytes, counts: bytes, range_bits: int):
    """Sorted fingerprints and their counts."""
    U = np.uint64
    if len(slots) % 2:
        used = np.flatnonzero(np.unpackbits(np.frombuffer(slots[1:], np.uint8))).astype(U)
    else:
        used = np.frombuffer(slots, np.uint16).astype(U)
    rest = 64 - range_bits - SLOT_BITS
    slot = np.repeat(used, np.frombuffer(runs, np.uint32))
    top = U(r << (64 - range_bits)) if range_bits else U(0)
    return top | (slot << U(rest)) | np.frombuffer(remainders, U), np.frombuffer(counts, U)


def merge_filters(filters, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lossless union of filters of one range: sorted remainders merged, equal ones added up."""
    parts = [decode_filter(*f, range_bits) for f in filters]
    values = np.concatenate([v for v, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[heads], np.add.reduceat(counts, heads)


def repeated_fingerprints(df: DataFrame, fp: str, range_bits: int) -> DataFrame:
    """``(fp, n)`` of the fingerprints that occur more than once."""
    ship_package(df.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if parts:
            rows = list(build_filter(np.concatenate(parts), range_bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))],
                ["range", "slots", "runs", "remainders", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(i).to_pylist() for i in range(5)))
        values, counts = merge_filters(rows, range_bits)
        twice = counts > 1
        return pa.table({"fp": values[twice].view(np.int64), "n": counts[twice].astype(np.int64)})

    filters = df.select(fp).mapInArrow(build, _FILTER)
    return filters.groupBy("range").applyInArrow(merge, "fp long, n long")


def _norm(text_col: str):
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\x0c\r", "")


def exact_duplicates(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 1 << 21) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. The row with the most code points stays, then
    the smallest id (a null id is the largest). Null text counts as empty; all empty texts are one group. Rows that
    repeat an id with a text of the same length count as rows of the group and share its decision. Other columns are
    not read. An empty table gives an empty result.
    """
    length = F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    keyed = docs.select(F.col(id_col).alias("doc_id"), length.alias("len"), _norm(text_col).alias("norm"))
    rows = materialise(keyed.select("doc_id", "len", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("fp")))
    range_bits = min(max((rows.count() // rows_per_range).bit_length(), 6), 40)
    repeated = materialise(repeated_fingerprints(rows, "fp", range_bits))
    # byte verification: of the texts whose fingerprint repeats, those with the very same bytes
    candidates = keyed.withColumn("fp", F.xxhash64("norm")).join(repeated.select("fp"), "fp", "left_semi")
    rank = F.struct(F.col("len"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("neg"))
    groups = materialise(
        candidates.groupBy("norm").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
        .select(F.sha2("norm", 256).alias("sha"), F.col("best.len").alias("best_len"), (-F.col("best.neg")).alias("best_id"), "size"))
    single = F.col("size").isNull()
    best = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("len") == F.col("best_len"))
    return rows.join(groups, "sha", "left").select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (single | best).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group, also where rows repeat an id."""
    found = materialise(exact_duplicates(docs, id_col, text_col))
    names = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sum")]
    keyed = docs.withColumn("__sha", F.sha2(_norm(text_col), 256))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__sum"))
    drop = found.where("not kept").select(*names).distinct()
    rest = keyed.join(drop, same, "left_anti")
    # rows that repeat an id: all of them share the decision "stays" above, one is left
    again = materialise(found.where("group_size > 1").groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("stays")).where("n > 1 and stays"))
    if not again.isEmpty():
        once = keyed.join(again.select("__id", "__sum"), same, "left_semi")
        longest = Window.partitionBy(id_col, "__sha").orderBy(F.char_length(text_col).desc(), *[F.col(c) for c in docs.columns])
        once = once.withColumn("__n", F.row_number().over(longest)).where("__n = 1").drop("__n")
        rest = keyed.join(drop.unionByName(again.select("__id", "__sum")), same, "left_anti").unionByName(once)
    return rest.drop("__sha")
