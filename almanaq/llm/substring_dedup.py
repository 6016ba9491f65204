"""Substring dedup with suffix automata of reference shards.

A window of words is removed when the same words also stand in a document with a smaller id. Only windows that can
repeat are looked at: every window is named by its minimizer (the smallest hash among its shorter word grams), which
depends on its words alone, and a minimizer that occurs in one document only can't repeat. Runs of windows with one
minimizer are cut out as passages of at most ``PIECE`` windows and routed by it to a shard's task, which streams them,
smallest id first, through the suffix automaton of the passages before: the matching statistics tell which windows stand
in it and who was first; a passage with a new window is added. Shards are routed to, not broadcast, because the
reference is the corpus itself and has no size bound.

Minimizers that several documents have are told to the tasks as a bit map of a fixed size. A false hit, or a full map at
a large scale, costs the routing of passages that needn't be; it changes nothing else. Minimizers of many passages don't
go to one task: their equal passages are one, by the SHA-256 of their words, and the windows of different passages are
grouped one by one the same way, with sums before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package
from .wordgrid import U, Words, chunks

WINDOW = 13
GRAM = 4
#: Minimizers of more runs than this are routed window by window.
COMMON = 4096
PIECE = 64  # windows of a passage; a longer run (one word over and over) is several passages
MAP_BITS = 1 << 26  # of each bit map of minimizers: 8 MB at any size of the corpus


class SuffixAutomaton:
    """Generalised suffix automaton over words; every state knows the first id whose passage reached it."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _clone(self, p: int, word, q: int) -> int:
        c = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.first.append(self.first[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, words: list, owner) -> None:
        """Adds a passage; passages must come in the order of their owners."""
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[last] + 1 == self.length[q] else self._clone(last, word, q)
                continue
            state = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            self.first.append(owner)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[state] = q if self.length[p] + 1 == self.length[q] else self._clone(p, word, q)
            last = state

    def owners(self, words: list, window: int) -> list:
        """For every window of the passage the first owner of its words, None where they are new."""
        state = matched = 0
        found = []
        nxt, link, length = self.next, self.link, self.length
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            if i + 1 >= window:
                if matched < window:
                    found.append(None)
                else:
                    while length[link[state]] >= window:
                        state = link[state]
                        matched = length[state]
                    found.append(self.first[state])
        return found


def first_owners(passages: list[tuple[int, list]], window: int = WINDOW) -> list[list[int]]:
    """First owner of every window of every passage ``(smallest id, words)``, in the order given."""
    automaton = SuffixAutomaton()
    out: list = [None] * len(passages)
    for i in sorted(range(len(passages)), key=lambda i: passages[i][0]):
        owner, words = passages[i]
        found = automaton.owners(words, window)
        if None in found:
            automaton.add(words, owner)
        out[i] = [owner if x is None else x for x in found]
    return out


def minimizer_runs(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window (as a word number of the chunk) and number of windows of every run of windows."""
    n = max(len(words.start) - window + 1, 0)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, _ = words.grams(gram, words.code)
    least = grams[:n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, grams[j:j + n], out=least)
    doc = words.doc[:n]
    valid = np.arange(n) + window <= words.first[doc + 1]
    opens = valid.copy()
    opens[1:] &= (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    at = np.flatnonzero(opens)
    total = np.r_[0, np.cumsum(valid)]
    return least[at], at, total[np.r_[at[1:], n]] - total[at]


def _joined(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _with_one_text(rows: DataFrame) -> DataFrame:
    """Without the ids that name several texts. Only the ids are read unless one repeats."""
    repeated = materialise(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if repeated.isEmpty():
        return rows
    code = F.sha2(F.coalesce("text", F.lit("")), 256)
    several = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(code).alias("a"), F.max(code).alias("b")).where("a <> b")
    return rows.join(materialise(several.select("id")), "id", "left_anti")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one seed (the first column, sorted) at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        seeds = np.array(b.column(0))
        cuts = np.flatnonzero(seeds[1:] != seeds[:-1]) + 1
        if held and len(seeds) and held[-1].column(0)[0].as_py() != int(seeds[0]):
            yield pa.concat_batches(held)
            held = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(seeds)]):
            if lo and held:
                yield pa.concat_batches(held)
                held = []
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.concat_batches(held)


def repeated_starts(ids: list[int], at: list[int], words: list[str], window: int) -> Iterator[tuple[int, list[int]]]:
    """Of the passages ``words`` of one seed, each at word ``at`` of document ``ids``: starts of windows owned by a smaller id."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    if ids[order[0]] == ids[order[-1]]:
        return
    first: dict[str, int] = {}
    for i in order:
        first.setdefault(words[i], ids[i])
    owners = dict(zip(first, first_owners([(owner, w.split(" ")) for w, owner in first.items()], window)))
    for i in order:
        starts = [at[i] + j for j, owner in enumerate(owners[words[i]]) if owner < ids[i]]
        if starts:
            yield ids[i], starts


def distinct_windows(passages: DataFrame, window: int) -> DataFrame:
    """``key, passage, nth, owner, hi``: the windows of the different passages among ``passages (passage, id, at, words)``.

    Equal passages are listed once, with their smallest and largest id.
    """
    different = passages.groupBy("passage").agg(F.min("id").alias("owner"), F.max("id").alias("hi"), F.first("words").alias("words"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [w.encode("utf-8", "surrogatepass").split(b" ") for w in b.column(3).to_pylist()]
            of = [(i, j) for i, words in enumerate(lines) for j in range(len(words) - window + 1)]
            rows = b.select([0, 1, 2]).take(pa.array([i for i, _ in of], pa.int64()))
            keys = [hashlib.sha256(b" ".join(lines[i][j:j + window])).digest() for i, j in of]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), rows.column(0), pa.array([j for _, j in of], pa.int32()), rows.column(1), rows.column(2)],
                ["key", "passage", "nth", "owner", "hi"])

    return different.mapInArrow(windows, "key binary, passage binary, nth int, owner long, hi long")


def repeated_in_common(passages: DataFrame, window: int) -> DataFrame:
    """``id, starts`` of the windows of ``passages`` that a smaller id owns, for passages of any number."""
    single = distinct_windows(passages, window)
    first = single.groupBy("key").agg(F.min("owner").alias("first"), F.max("hi").alias("last")).where("first < last").drop("last")
    # At most as many entries as a passage has windows.
    owned = single.join(first, "key").where("first < hi").groupBy("passage").agg(F.collect_list(F.struct("nth", "first")).alias("_owned"))
    mine = F.filter("_owned", lambda w: w["first"] < F.col("id"))
    return passages.select("passage", "id", "at").join(owned, "passage").select(
        "id", F.transform(mine, lambda w: w["nth"] + F.col("at")).alias("starts")).where(F.size("starts") > 0)


def _seeds_of_several(runs: DataFrame, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit maps of the seeds that several ids have, and of those with more than ``common`` runs."""
    # two documents at least share a seed when its smallest and largest id differ
    many = runs.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    place = F.col("seed").bitwiseAND(MAP_BITS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    found = many.select((F.shiftright(place, 6)).alias("slot"), bit.alias("bit"), (F.col("n") > common).alias("common")).groupBy("slot").agg(
        F.bit_or("bit").alias("many"), F.bit_or(F.when(F.col("common"), F.col("bit"))).alias("common")).toArrow()
    maps = []
    for name in ("many", "common"):
        bits = np.zeros(MAP_BITS // 64, U)
        bits[np.array(found.column("slot"))] = np.array(found.column(name).fill_null(0)).view(U)
        maps.append(bits)
    return maps[0], maps[1]


def _in_map(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    place = (seeds & U(MAP_BITS - 1)).astype(np.int64)
    return (bits[place >> 6] >> (place & 63).astype(U)) & U(1) == U(1)


def _pieces(w: Words, at: np.ndarray, n: np.ndarray, size: int, window: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Seed, first word and words of the runs' passages of at most ``size`` windows. A passage's words are joined by a space."""
    parts = -(-n // size)
    run = np.repeat(np.arange(len(at)), parts)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = at[run] + nth * size
    last = start + np.minimum(n[run] - nth * size, size) + window - 2
    body, lo, hi = w.data.tobytes(), w.start[start].tolist(), w.end[last].tolist()
    return seeds[run], start, [b" ".join(body[a:b].split()) for a, b in zip(lo, hi)]


def substring_dedup(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, common: int = COMMON, piece: int = PIECE) -> DataFrame:
    """``doc_id, n_words, n_removed, clean_text`` per row of ``docs``; the kept words joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``; null text has none. Rows whose id is null, or names several
    texts, have no place in the order: they lose nothing and nothing is lost because of them. Rows equal in id and text
    come out alike. Other columns are not read; an empty table gives an empty result. A very long text is read in
    memory in proportion to its length and routed in passages of at most ``piece`` windows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = _with_one_text(source.where("id is not null"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in chunks(b.column(1)):
                w = Words(texts)
                least, at, _ = minimizer_runs(w, window, GRAM)
                ids = b.column(0).slice(lo, hi - lo).take(pa.array(w.doc[at]))
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), ids], ["seed", "id"])

    maps = _seeds_of_several(ordered.mapInArrow(seeds, "seed long, id long"), common)
    several, hot = (spark.sparkContext.broadcast(m) for m in maps)

    def passages(common_ones: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, texts in chunks(b.column(1)):
                    w = Words(texts)
                    least, at, n = minimizer_runs(w, window, GRAM)
                    keep = _in_map(hot.value, least) if common_ones else _in_map(several.value, least) & ~_in_map(hot.value, least)
                    seed, start, words = _pieces(w, at[keep], n[keep], piece, window, least[keep])
                    doc = w.doc[start] if len(start) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seed.view(np.int64)), b.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array((start - w.first[doc]).astype(np.int32)),
                         pa.array([x.decode("utf-8", "surrogatepass") for x in words], pa.string())], ["seed", "id", "at", "words"])

        return cut

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        starts: list[list[int]] = []
        for group in _groups(batches):
            if len(group) > 1:
                for id_, found in repeated_starts(*(group.column(i).to_pylist() for i in (1, 2, 3)), window):
                    ids.append(id_)
                    starts.append(found)
            if len(ids) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], ["id", "starts"])
                ids, starts = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], ["id", "starts"])

    shape = "seed long, id long, at int, words string"
    routed = ordered.mapInArrow(passages(False), shape).repartition("seed").sortWithinPartitions("seed")
    hits = routed.mapInArrow(stream, "id long, starts array<int>")
    if maps[1].any():
        many = ordered.mapInArrow(passages(True), shape).select(F.unhex(F.sha2("words", 256)).alias("passage"), "id", "at", "words")
        hits = hits.union(repeated_in_common(many, window))
    hits = hits.groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = [None if t is None else squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["id", "packed"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for b in batches:
            n_words, n_removed, lines = [], [], []
            for blob, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = loosen.decompress(blob).split() if blob is not None else []
                edge = np.zeros(len(words) + window + 1, np.int32)
                np.add.at(edge, np.array(starts or [], np.int64), 1)
                np.add.at(edge, np.array(starts or [], np.int64) + window, -1)
                gone = np.cumsum(edge)[:len(words)] > 0
                kept = [w for w, x in zip(words, gone.tolist()) if not x] if starts else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                lines.append(_joined(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(lines, pa.string())], ["doc_id", "n_words", "n_removed", "clean_text"])

    out = "doc_id long, n_words long, n_removed long, clean_text string"
    every = source.mapInArrow(pack, "id long, packed binary")
    return every.join(hits, "id", "left").select("id", "packed", "starts").mapInArrow(drop, out)
