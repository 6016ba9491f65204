"""Phrase collocations by Toivonen mining.

A sample of the documents proposes frequent phrases, level by level, with a lowered threshold. A full pass counts them
exactly, together with their negative border: every phrase that is not among the proposals, but whose first and last
words (all but one) are. A border phrase that turns out to be frequent is a failure of the sample; its extensions were
not counted. It joins the proposals, and a further pass counts the phrases that became countable by it, until there is
no failure. Then every frequent phrase has been counted exactly, whatever the sample was.

The proposals are told to the tasks as a bit map of a fixed size: a false hit costs the count of a phrase that needn't
be counted and changes nothing else. Phrases are counted by their words, never by a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship_package
from .wordgrid import _BASE, LOWER, U, byte_view, grouped, hash_spans, mix, number_spans, raw, strings

LONGEST = 4  # words of a phrase
MIN_COUNT = 30
TOP = 2000
UNKNOWN = "und"  # fixed value: language of rows without one
SAMPLE_OF = 8  # one document in so many is in the sample
SAMPLE_COUNT = 2  # a phrase so frequent in the sample is proposed
MAP_BITS = 1 << 26  # of the bit map of proposals: 8 MB at any size of the corpus
BATCH = 4 << 20  # bytes of text counted together in a task
_SLICE = 100_000  # rows of a batch that a task returns
#: What ends a piece, and what parts words inside it.
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09]] = True


class Corpus:
    """Words of some texts, and for each word its language, its piece and its number, which is that of (language, word)."""

    def __init__(self, langs: list[str], texts: pa.Array):
        data, off = raw(texts)
        data = LOWER[data]
        n = len(data)
        self.view = byte_view(data)
        breaks = np.zeros(n + 1, np.int64)
        np.cumsum(BREAK[data], out=breaks[1:])
        inside = np.zeros(n + 2, bool)
        inside[1:n + 1] = ~(BREAK[data] | GAP[data])
        cut = np.zeros(n + 2, bool)
        cut[off + 1] = True
        self.start = np.flatnonzero(inside[1:n + 1] & (~inside[:n] | cut[1:n + 1]))
        self.length = np.flatnonzero(inside[1:n + 1] & (~inside[2:] | cut[2:])) + 1 - self.start
        self.first = np.searchsorted(self.start, off)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        piece = breaks[self.start] + doc  # grows from piece to piece, over the texts too
        self.joined = np.zeros(len(doc), bool)  # with the word before
        self.joined[1:] = piece[1:] == piece[:-1]
        self.names = sorted(set(langs))
        index = {x: i for i, x in enumerate(self.names)}
        self.lang = np.array([index[x] for x in langs], np.int64)[doc] if len(langs) else np.zeros(0, np.int64)
        self.code = hash_spans(self.view, self.start, self.length)

    def number(self, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, int]:
        """Numbers of (language, word) of the words at ``at``, equal exactly where both are, and a bound of them."""
        number, lead = number_spans(self.view, self.start[at], self.length[at], self.code[at])
        return number * len(self.names) + self.lang[at], len(lead) * len(self.names)

    def places(self) -> Iterator[np.ndarray]:
        """Place in the bit map of the phrase of 1, 2, ... words from each word on."""
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in self.names], U)
        h = mix(self.code ^ salt[self.lang]) if len(self.code) else self.code
        for k in range(1, LONGEST + 1):
            yield (h & U(MAP_BITS - 1)).astype(np.int64)
            h = mix(h[:-1] * U(_BASE) + self.code[k:])

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The ``k`` words from each place of ``at`` on, joined by one space."""
        word = (at[:, None] + np.arange(k)).ravel()
        size = self.length[word] + 1
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        body = self.view.base[np.repeat(self.start[word] - (ends - size), size) + np.arange(total)]
        body[ends - 1] = 0x20
        last = ends[k - 1::k]
        keep = np.ones(total, bool)
        keep[last - 1] = False
        off = np.r_[0, last - np.arange(1, len(at) + 1)].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off), pa.py_buffer(body[keep])).cast(pa.string())


def _has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 6] >> (place & 63).astype(U)) & U(1) == U(1)


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[str], pa.Array]]:
    """Languages and texts, about ``limit`` bytes of whole texts at a time."""
    langs, parts, size = [], [], 0
    for b in batches:
        texts = strings(b.column(1))
        _, off = raw(texts)
        lo, here = 0, b.column(0).to_pylist()
        while lo < len(texts):
            hi = max(int(np.searchsorted(off, off[lo] + max(limit - size, 0), "right")) - 1, lo + 1)
            langs += here[lo:hi]
            parts.append(texts.slice(lo, hi - lo))
            size += int(off[hi] - off[lo])
            lo = hi
            if size >= limit or lo < len(texts):
                yield langs, pa.concat_arrays(parts)
                langs, parts, size = [], [], 0
    if langs:
        yield langs, pa.concat_arrays(parts)


def countable(c: Corpus, bits: np.ndarray, upto: int = LONGEST) -> list[np.ndarray]:
    """For each word and k = 1 .. ``upto``: does a phrase of k words start there that is a proposal or in the border?

    A single word always is; a longer phrase is where its first and its last k - 1 words are both in the bit map.
    """
    n = len(c.start)
    out = [np.ones(n, bool)]
    for k, place in zip(range(2, upto + 1), c.places()):
        known = np.zeros(n, bool)
        known[:len(place)] = _has(bits, place)
        known &= out[-1]
        here = np.zeros(n, bool)
        if n > 1:
            here[:-1] = known[:-1] & known[1:] & c.joined[1:]
        out.append(here)
    return out


def count_phrases(docs: DataFrame, bits, before=None, levels: tuple[int, int] = (1, LONGEST)) -> DataFrame:
    """``lang, k, phrase, n`` of all countable phrases of ``levels`` in ``docs (lang, text)``, not yet added up over tasks.

    Those that were countable with the bit map ``before`` are left out. ``k = 0`` has the number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _gathered(batches, BATCH):
            c = Corpus(langs, texts)
            if not len(c.start):
                continue
            allowed = countable(c, bits.value, levels[1])
            names = pa.array(c.names, pa.string())
            if before is not None:
                found = _new_ones(c, allowed, countable(c, before.value, levels[1]))
            else:
                found = _all_levels(c, allowed, levels[0])
                if levels[0] == 1:
                    yield _rows(names, 0, pa.array([""] * len(c.names), pa.string()), np.bincount(c.lang, minlength=len(c.names)))
            for k, at, n in found:
                for lo in range(0, len(at), _SLICE):
                    part = at[lo:lo + _SLICE]
                    yield _rows(names.take(pa.array(c.lang[part])), k, c.phrases(part, k), n[lo:lo + _SLICE])

    return docs.mapInArrow(run, "lang string, k int, phrase string, n long")


def _all_levels(c: Corpus, allowed: list[np.ndarray], lowest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Level, a place, and count of every countable phrase from level ``lowest`` on. A level's numbers name the next one's."""
    number, size = c.number()
    place, n = np.zeros(size, np.int64), np.bincount(number, minlength=size)
    place[number] = np.arange(len(number))
    there = np.flatnonzero(n)
    if lowest == 1:
        yield 1, place[there], n[there]
    for k in range(2, len(allowed) + 1):
        at = np.flatnonzero(allowed[k - 1])
        lead, group, n = grouped(number[at] * size + number[at + 1])  # of the phrases one word shorter, which overlap
        if k >= lowest:
            yield k, at[lead], n
        number, size = np.zeros(len(number), np.int64), len(lead)
        number[at] = group


def _new_ones(c: Corpus, allowed: list[np.ndarray], old: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Level, a place, and count of every phrase that is countable now and was not before."""
    for k in range(2, len(allowed) + 1):
        at = np.flatnonzero(allowed[k - 1] & ~old[k - 1])
        if not len(at):
            continue
        number, size = c.number((at[:, None] + np.arange(k)).ravel())
        number = number.reshape(-1, k)
        group = number[:, 0]
        for j in range(1, k):
            lead, group, n = grouped(group * size + number[:, j])
        yield k, at[lead], n


def _rows(langs: pa.Array, k: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(n), k, np.int32)), phrases, pa.array(n.astype(np.int64))], ["lang", "k", "phrase", "n"])


def _added_up(counts: DataFrame, least: int) -> DataFrame:
    """Counts over all tasks. Tasks have added up theirs, so rows go to the shuffle as they are."""
    total = counts.repartition("lang", "phrase").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return total.where((F.col("n") >= least) | (F.col("k") == 0))


def _map_rows(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of ``(lang, phrase, k, ...)`` with the phrases' places in the bit map."""
    for b in batches:
        c = Corpus(b.column(0).to_pylist(), strings(b.column(1)))
        k, place = np.array(b.column(2)), np.zeros(b.num_rows, np.int64)
        for length, places in enumerate(c.places(), 1):
            at = np.flatnonzero(k == length)
            place[at] = places[c.first[at]]
        yield b, place


def bit_map(phrases: DataFrame, old: np.ndarray | None = None) -> np.ndarray:
    """The bit map of ``phrases (lang, phrase, k)``, besides what ``old`` has: ``MAP_BITS / 8`` bytes at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, place in _map_rows(batches, None):
            slot, group = np.unique(place >> 6, return_inverse=True)
            word = np.zeros(len(slot), U)
            np.bitwise_or.at(word, group, U(1) << (place & 63).astype(U))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(word.view(np.int64))], ["slot", "word"])

    found = phrases.select("lang", "phrase", "k").mapInArrow(run, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    bits = np.zeros(MAP_BITS // 64, U) if old is None else old.copy()
    bits[np.array(found.column("slot"))] |= np.array(found.column("word")).view(U)
    return bits


def _failures(phrases: DataFrame, bits) -> DataFrame:
    """The rows of ``phrases (lang, phrase, k)`` that the bit map doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, place in _map_rows(batches, None):
            yield b.filter(pa.array(~_has(bits.value, place)))

    return phrases.select("lang", "phrase", "k").mapInArrow(run, "lang string, phrase string, k int")


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, sample_of: int = SAMPLE_OF, sample_count: int = SAMPLE_COUNT) -> DataFrame:
    """``lang, k, phrase, n``: every phrase of up to ``LONGEST`` words with ``n >= least``, exactly; ``k = 0``: all words.

    ``docs`` has ``id, lang, text``. The sample takes rows by a hash of the id.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select("lang", "text")
    drawn = materialise(docs.where(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(sample_of)) == 0).select("lang", "text"))
    bits = np.zeros(MAP_BITS // 64, U)
    for k in range(1, LONGEST):
        proposed = _added_up(count_phrases(drawn, sc.broadcast(bits), None, (k, k)), sample_count).where(f"k = {k}")
        bits = bit_map(proposed, bits)
    now = sc.broadcast(bits)
    new = materialise(_added_up(count_phrases(rows, now), least))
    found = [new]
    while True:  # each failure is a phrase that was none before, and longer phrases follow from it: LONGEST passes at most
        failed = materialise(_failures(new.where(f"k between 1 and {LONGEST - 1}"), now))
        if failed.isEmpty():
            break
        bits = bit_map(failed, bits)
        before, now = now, sc.broadcast(bits)
        new = materialise(_added_up(count_phrases(rows, now, before), least))
        found.append(new)
    out = found[0]
    for t in found[1:]:
        out = out.unionByName(t)
    return out


def _score(a: Column, l: Column, r: Column) -> Column:
    """``floor(2000000 * a / (l + r))`` with a product of up to 38 digits."""
    wide = F.lit(2_000_000).cast("decimal(8,0)") * a.cast("decimal(20,0)")
    return F.call_function("div", wide, (l + r).cast("decimal(20,0)")).cast("long")


def collocations(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, top: int = TOP,
        sample_of: int = SAMPLE_OF, sample_count: int = SAMPLE_COUNT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``LONGEST`` words.

    A phrase's count ``a`` is at least ``least``. Its score is that of its lowest-scoring cut into a first part (count
    ``l``) and a rest (``r``), of equal ones the earliest cut. Phrases inside a longer one with four fifths of their
    count are left out. Equal scores rank by ``a``, then by the phrase's bytes. Null text has no words, null language is
    ``und``; ids only draw the sample, so null and repeated ones don't matter, and rows that repeat count each. Other
    columns are not read. A very long text costs memory in proportion to its length (about 100 bytes a byte); time is
    linear. No rows, or none frequent: no rows.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    counted = materialise(frequent_phrases(source, least, sample_of, sample_count))
    phrases = counted.where("k > 0").select("lang", "phrase", "n")
    candidates = counted.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = candidates.select("lang", "k", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = (
        cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("m")))
    # the largest count of a longer phrase around each phrase
    start, size = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("start"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size")
    inner = candidates.where("k > 2").select("lang", "k", "a", "w", size).select("lang", "k", "a", "w", "size", start).where("start + size <= k + 1")
    around = inner.select("lang", part(F.col("start"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    free = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < 80 * wide("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = free.select("lang", "phrase", "a", "m.l", "m.r", "m.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = counted.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
