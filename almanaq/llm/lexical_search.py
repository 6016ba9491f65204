"""Ranked lexical search with range-maximum sparse tables.

Every task indexes segments of its documents: one posting list per query term, with the term's impact in each document,
and over each list a sparse table that gives the largest impact of any range in two look-ups. An item's search starts
with the interval of all documents. The sum of its terms' range maxima bounds every score inside an interval; the
interval with the largest bound comes first, is split at the document with the largest single impact, that document is
scored in full, and the two halves follow with their own bounds. The search ends when no bound reaches the score that an
item's last result has. Many intervals are split at once, with the same numpy operations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package
from .wordgrid import LOWER, U, byte_view, chunks, hash_spans, number_spans, raw, same_spans, strings

TOP = 10
BLOCK_BYTES = 4 << 20  # texts of the items that are searched for at once
SEGMENT_BYTES = 48 << 20  # texts of the documents of a segment
SEGMENT_POSTINGS = 2_000_000  # and their postings, which the sparse tables follow
_CELLS = 1 << 17  # interval-term cells of a round
#: The bytes of a term (digits, letters, everything beyond ASCII).
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Terms:
    """Terms of a chunk of texts: maximal runs of term bytes, A-Z lower-cased."""

    def __init__(self, texts: pa.Array):
        data, self.off = raw(texts)
        n = len(data)
        self.view = byte_view(LOWER[data])
        inside = np.zeros(n + 2, bool)
        inside[1:n + 1] = TERM[data]
        cut = np.zeros(n + 2, bool)
        cut[self.off + 1] = True
        self.start = np.flatnonzero(inside[1:n + 1] & (~inside[:n] | cut[1:n + 1]))
        end = np.flatnonzero(inside[1:n + 1] & (~inside[2:] | cut[2:])) + 1
        self.length = end - self.start
        first = np.searchsorted(self.start, self.off)
        self.n = np.diff(first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.code = hash_spans(self.view, self.start, self.length)


@dataclass
class Queries:
    """Distinct terms of a block of items as bytes, and of each item the numbers of its terms."""

    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    items: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str | None]) -> "Queries":
        t = Terms(strings(pa.array(texts, pa.large_string())))
        number, lead = number_spans(t.view, t.start, t.length, t.code) if len(t.start) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        pair = np.unique(t.doc.astype(np.int64) * max(len(lead), 1) + number)
        bounds = np.searchsorted(pair, np.arange(len(texts) + 1) * max(len(lead), 1))
        items = [pair[a:b] % max(len(lead), 1) for a, b in zip(bounds, bounds[1:])]
        length = t.length[lead]
        at = np.cumsum(length) - length
        where = np.repeat(t.start[lead] - at, length) + np.arange(int(length.sum()))
        return cls(t.view.base[where], at, length, items)

    def prepare(self) -> None:
        """Search order of the terms, in each task."""
        self.view = byte_view(self.words)
        code = hash_spans(self.view, self.start, self.length)
        self.order = np.argsort(code, kind="stable")
        self.keys = code[self.order]

    def match(self, t: Terms) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the query terms among the terms of ``t``, and their numbers. Found by hash, compared by bytes."""
        where, which = [], []
        at = np.searchsorted(self.keys, t.code)
        open_ = np.flatnonzero(at < len(self.keys))
        while len(open_):
            open_ = open_[self.keys[at[open_]] == t.code[open_]]
            term = self.order[at[open_]]
            same = self.length[term] == t.length[open_]
            same[same] = same_spans(t.view, t.start[open_[same]], self.view, self.start[term[same]], t.length[open_[same]])
            where.append(open_[same])
            which.append(term[same])
            open_ = open_[~same]
            at[open_] += 1  # another term with this hash
            open_ = open_[at[open_] < len(self.keys)]
        return np.concatenate([np.zeros(0, np.int64), *where]), np.concatenate([np.zeros(0, np.int64), *which])


def postings_of(t: Terms, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and number of occurrences of every query term in every text that has it."""
    where, which = q.match(t)
    key, tf = np.unique(which * np.int64(max(len(t.n), 1)) + t.doc[where], return_counts=True)
    return key % max(len(t.n), 1), key // max(len(t.n), 1), tf


class Segment:
    """Posting lists of some documents, in order of their ids, with a sparse table of the place of each range's maximum.

    ``doc, term, impact``: a posting each; documents are numbered from 0.
    """

    def __init__(self, n_docs: int, n_terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, term))
        self.n_docs, self.doc, self.impact = n_docs, doc[order], impact[order]
        self.key = term[order].astype(np.int64) * n_docs + self.doc
        self.bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        longest = int(np.diff(self.bounds).max(initial=0))
        level = np.arange(len(self.doc), dtype=np.int32)
        self.levels = [level]
        half = 1
        while 2 * half <= longest:
            # ranges that reach into the next list are never asked for
            a, b = level[:len(level) - half], level[half:]
            level = np.where(self.impact[a] >= self.impact[b], a, b)
            self.levels.append(level)
            half *= 2
        width = max(map(len, self.levels))
        self.table = np.zeros((len(self.levels), width), np.int32)
        for row, values in zip(self.table, self.levels):
            row[:len(values)] = values
        del self.levels

    def top(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the largest impact among postings ``a .. b - 1`` of one list, for each pair; -1 for an empty range."""
        size = b - a
        out = np.full(a.shape, -1, np.int64)
        at = size > 0
        lo, hi = a[at], b[at]
        level = np.frexp(size[at].astype(np.float64))[1] - 1
        x, y = self.table[level, lo], self.table[level, hi - (1 << level)]
        out[at] = np.where(self.impact[x] >= self.impact[y], x, y)
        return out

    def search(self, terms: np.ndarray, k: int, floor: tuple[int, int] | None, ids: np.ndarray) -> list[tuple[int, int]]:
        """``(score, document)`` of the best ``k`` documents of the terms; ids break ties, the smaller first.

        ``floor`` is a score and an id that results must come before: those of the last one of ``k`` found elsewhere.
        """
        lists = terms[self.bounds[terms + 1] > self.bounds[terms]]
        found: list[tuple[int, int]] = []
        if not len(lists):
            return found
        batch = max(1, _CELLS // len(lists))
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n_docs)
        a, b = self.bounds[lists][None, :], self.bounds[lists + 1][None, :]
        peak = self.top(a, b)
        bound = np.where(peak >= 0, self.impact[peak], 0).sum(1)
        best_score, best_id, best_doc = (np.zeros(0, np.int64) for _ in range(3))
        limit = floor
        while len(bound):
            if limit is not None:
                # an interval stays if it may hold a better score, or an equal one with a smaller id
                stay = (bound > limit[0]) | ((bound == limit[0]) & (ids[lo] < limit[1]))
                lo, hi, a, b, peak, bound = lo[stay], hi[stay], a[stay], b[stay], peak[stay], bound[stay]
                if not len(bound):
                    break
            if len(bound) > batch:  # the largest bounds first
                order = np.argpartition(-bound, batch)
                now, later = order[:batch], order[batch:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            impact = np.where(peak[now] >= 0, self.impact[peak[now]], 0)
            at = impact.argmax(1)
            d = self.doc[peak[now, at]]
            # where the document stands, or would stand, in each of the lists
            target = lists[None, :] * np.int64(self.n_docs) + d[:, None]
            cut = np.searchsorted(self.key, target)
            cut = np.clip(cut, a[now], b[now])
            inside = cut < b[now]
            holds = inside & (self.key[np.where(inside, cut, 0)] == target)
            score = np.where(holds, self.impact[np.where(inside, cut, 0)], 0).sum(1)
            best_score, best_id, best_doc = np.r_[best_score, score], np.r_[best_id, ids[d]], np.r_[best_doc, d]
            order = np.lexsort((best_id, -best_score))[:k]
            best_score, best_id, best_doc = best_score[order], best_id[order], best_doc[order]
            if len(order) == k and (limit is None or (-int(best_score[-1]), int(best_id[-1])) < (-limit[0], limit[1])):
                limit = int(best_score[-1]), int(best_id[-1])
            new_lo, new_hi = np.r_[lo[now], d + 1], np.r_[d, hi[now]]
            new_a, new_b = np.concatenate([a[now], cut + holds]), np.concatenate([cut, b[now]])
            new_peak = self.top(new_a, new_b)
            new_bound = np.where(new_peak >= 0, self.impact[new_peak], 0).sum(1)
            open_ = new_bound > 0
            lo, hi, bound = np.r_[lo[later], new_lo[open_]], np.r_[hi[later], new_hi[open_]], np.r_[bound[later], new_bound[open_]]
            a, b, peak = (np.concatenate([old[later], new[open_]]) for old, new in ((a, new_a), (b, new_b), (peak, new_peak)))
        return [(int(s), int(d)) for s, d in zip(best_score, best_doc) if s > 0]


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, total: int, docs: int) -> np.ndarray:
    """Impact of a term of ``weight`` in documents of ``n`` terms; ``total`` terms in all ``docs``. 64-bit integers."""
    m = 100 - 90 + (90 * n * docs) // max(total, 1)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _statistics(docs: DataFrame, q: Queries) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and the documents that hold each query term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q.prepare()
        df = np.zeros(len(q.length) + 2, np.int64)
        for b in batches:
            for _, _, texts in chunks(b.column(0)):
                t = Terms(texts)
                _, term, _ = postings_of(t, q)
                df[:-2] += np.bincount(term, minlength=len(q.length))
                df[-2:] += np.count_nonzero(t.n), int(t.n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    out = np.zeros(len(q.length) + 2, np.int64)
    for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return int(out[-2]), int(out[-1]), out[:-2]


def _search(docs: DataFrame, q: Queries, k: int) -> DataFrame:
    """``item, doc_id, no_id, score``: the best ``k`` of each task for each item of the block."""
    n_docs, total, df = _statistics(docs, q)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    none = np.iinfo(np.int64).max  # stands for a null id: after all others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q.prepare()
        best: list[list[tuple[int, int, bool]]] = [[] for _ in q.items]  # (-score, id, no id)
        parts: list[tuple] = []
        size = postings = held = 0

        def close() -> None:
            ids, null = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            doc, term, impact = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            segment = Segment(len(ids), len(q.length), place[doc], term, impact)
            ids, null = ids[order], null[order]
            for item, terms in enumerate(q.items):
                mine = best[item]
                floor = (-mine[-1][0], mine[-1][1]) if len(mine) == k else None
                found = segment.search(terms, k, floor, ids)
                if found:
                    best[item] = sorted([*mine, *((-s, int(ids[d]), bool(null[d])) for s, d in found)])[:k]

        for b in batches:
            for lo, hi, texts in chunks(b.column(1)):
                t = Terms(texts)
                doc, term, tf = postings_of(t, q)
                ids = b.column(0).slice(lo, hi - lo)
                null = np.array(ids.is_null())
                parts.append((np.array(ids.fill_null(none)), null, doc + held, term, impacts(weight[term], tf, t.n[doc], total, n_docs)))
                size, postings, held = size + int(t.off[-1]), postings + len(doc), held + hi - lo
                if size >= SEGMENT_BYTES or postings >= SEGMENT_POSTINGS:
                    close()
                    parts.clear()
                    size = postings = held = 0
        if parts:
            close()
        rows = [(item, None if null else i, -s) for item, mine in enumerate(best) for s, i, null in mine]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            ["item", "doc_id", "score"])

    return docs.select("id", "text").mapInArrow(run, "item long, doc_id long, score long")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes`` of text, one partition of them on the driver at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        n = len((r[1] or "").encode("utf-8", "surrogatepass"))
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def lexical_search(
        docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
        item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: of each row of ``items`` its ``k`` best documents with a score above 0.

    All documents are searched for all items, items in blocks of ``block_bytes`` of text (a longer text is a block of its
    own); each block is two passes over the documents: statistics, then search. Equal scores rank by ascending id, null
    ids last. Null or empty texts have no terms: such documents count nowhere, such items have no rows. Rows that repeat
    an id are documents of their own, rows that repeat an item are ranked each for itself. Other columns are not read.
    A segment of a task holds about ``SEGMENT_BYTES`` of text, or one longer text: a very long text costs memory in
    proportion to its own length only. No documents or items: no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kind = items.schema[item_col].dataType
    out = None
    for block in _blocks(items.select(item_col, item_text_col), block_bytes):
        q = Queries.of([t for _, t in block])
        if not len(q.length):
            continue
        found = _search(source, q, k)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"item long, item_id {kind.simpleString()}")
        ranked = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out
