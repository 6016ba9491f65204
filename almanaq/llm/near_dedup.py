"""MinHash near-dedup with odd sketches.

A document is its set of distinct word shingles. MinHash samples give band keys (candidates) and are folded into an odd
sketch: a bit map in which every sample flips one bit, so that the XOR of two sketches counts the samples that differ
and estimates high similarities well. Candidate pairs whose sketches agree enough are confirmed on the full sets.

Large groups never become all pairs: equal sets are one class; in every bucket the members are first paired with one
leader only; what is confirmed merges into components; members outside their bucket's largest component are then paired
with a few leaders of it; and of the members of buckets that still hold several components only those of different
components are paired afterwards, those of a largest component being one side only, and only if they share one of the
rare shingles without which a pair can't be linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package
from .wordgrid import _BASE, LOWER, U, Words, chunks, mix

WIDTH = 2  # words of a shingle of op7
ROWS, BANDS = 7, 70  # two sets of similarity 0.8 miss each other in all bands once in 15 million times
SAMPLES = ROWS * BANDS
SKETCH_BITS = 2048
#: Sketches of a linked pair agree to at least this estimate, but for about one pair in a billion.
MIN_ESTIMATE = 0.65
LEADERS = 8  # of a bucket's largest component, in the second round


@lru_cache(1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def _shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, ordered by text and hash: text, hash, first word and number of words.

    Shingles of one text and hash are compared word by word; those that differ stay apart.
    """
    code = words.code
    grams, valid = words.grams(width, code)
    at = np.flatnonzero(valid)
    docs, values, heads, sizes = [words.doc[at]], [grams[at]], [at], [np.full(len(at), width)]
    for k in range(1, width):
        short = np.flatnonzero(words.n == k)
        head = words.first[short]
        h = code[head]
        for j in range(1, k):
            h = h * U(_BASE) + code[head + j]
        docs.append(short)
        values.append(mix(h + U(k)))
        heads.append(head)
        sizes.append(np.full(len(short), k))
    doc, value, head, size = map(np.concatenate, (docs, values, heads, sizes))
    order = np.lexsort((value, doc))
    doc, value, head, size = doc[order], value[order], head[order], size[order]
    twin = np.flatnonzero((doc[1:] == doc[:-1]) & (value[1:] == value[:-1]))  # of one size: a text's shingles are
    same = np.ones(len(twin), bool)
    for j in range(width):
        longer = size[twin] > j
        same[longer] &= words.same_words(head[twin[longer]] + j, head[twin[longer] + 1] + j)
    keep = np.ones(len(doc), bool)
    keep[twin[same] + 1] = False
    if not same.all():  # two shingles share a hash: told apart by their words
        number = words.numbers[0]
        seen: set[tuple] = set()
        for i in np.flatnonzero(np.isin(value, value[twin[~same]])).tolist():
            key = (int(doc[i]), *number[head[i]:head[i] + size[i]].tolist())
            keep[i] = key not in seen
            seen.add(key)
    return doc[keep], value[keep], head[keep], size[keep]


def shingle_sets(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes) of every text, sorted within the text, and the number of them.

    Shingles are ``width`` words in a row; a shorter text with words is one shingle.
    """
    doc, value, _, _ = _shingles(words, width)
    return value, np.bincount(doc, minlength=len(words.n))


def set_digests(words: Words, doc: np.ndarray, head: np.ndarray, size: np.ndarray, value: np.ndarray) -> list[bytes | None]:
    """SHA-256 of each text's set of shingles: the shingles' words, in the order of ``value``; None without words."""
    n = int(size.max(initial=0))
    # the words of each shingle in a row; the byte behind a word is white space, which is made one space
    word = np.repeat(head - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    length = words.end[word] - words.start[word] + 1
    at = np.cumsum(length)
    where = np.repeat(words.start[word] - (at - length), length) + np.arange(int(at[-1]) if len(at) else 0)
    padded = np.append(words.data, np.uint8(0x20))
    body = padded[where]
    body[at - 1] = 0x20
    last = np.cumsum(size) - 1
    body[at[last] - 1] = 0x0A  # neither occurs inside a word
    ties = np.flatnonzero((doc[1:] == doc[:-1]) & (value[1:] == value[:-1]))
    bounds = np.r_[0, at[last]] if n else np.zeros(1, np.int64)
    first = np.searchsorted(doc, np.arange(len(words.n) + 1))
    odd = set(doc[ties].tolist())
    out: list[bytes | None] = []
    for d in range(len(words.n)):
        lo, hi = first[d], first[d + 1]
        if lo == hi:
            out.append(None)
            continue
        piece = body[bounds[lo]:bounds[hi]].tobytes()
        if d in odd:  # equal hashes leave the order open
            piece = b"\n".join(sorted(piece.split(b"\n")))
        out.append(hashlib.sha256(piece).digest())
    return out


def signatures(shingles: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """Band keys and odd sketches of the texts that have shingles."""
    starts = np.cumsum(size) - size
    scrambled = mix(shingles)
    low = (scrambled >> U(32)).astype(np.uint32)
    mult, add = _seeds()
    sample = np.empty((SAMPLES, len(size)), np.uint32)
    for i in range(SAMPLES):
        sample[i] = np.minimum.reduceat(low * mult[i] + add[i], starts)
    wide = sample.astype(np.uint64)
    bands = np.zeros((BANDS, len(size)), np.uint64)
    for b in range(BANDS):
        h = np.full(len(size), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * U(0x9E3779B97F4A7C15) + wide[b * ROWS + r])
        bands[b] = h
    bit = mix(wide + (np.arange(1, SAMPLES + 1, dtype=np.uint64) << U(32))[:, None]) % U(SKETCH_BITS)
    flips = np.bincount((np.arange(len(size))[None, :] * SKETCH_BITS + bit.astype(np.int64)).ravel(), minlength=len(size) * SKETCH_BITS)
    sketch = np.packbits((flips & 1).astype(np.uint8)).view(np.uint64).reshape(len(size), -1)
    return {"bands": bands.T, "sketch": sketch}


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


_SIGNED = "id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"


def sign(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``id, n_shingles, digest, bands, sketch`` of ``(id, text)``; no digest or bands for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in chunks(b.column(1)):
                words = Words(texts, lower=True)
                doc, shingles, head, lengths = _shingles(words, width)
                size = np.bincount(doc, minlength=len(words.n))
                full = np.flatnonzero(size > 0)
                arrays = {}
                has = (size > 0).astype(np.int32)
                s = signatures(shingles, size[full]) if len(full) else {"bands": np.zeros(0, np.uint64), "sketch": np.zeros(0, np.uint64)}
                for k, count in (("bands", BANDS), ("sketch", SKETCH_BITS // 64)):
                    off = np.zeros(len(size) + 1, np.int32)
                    np.cumsum(has * count, out=off[1:])
                    arrays[k] = pa.ListArray.from_arrays(pa.array(off), pa.array(_signed(s[k]).ravel()))
                digest = pa.array(set_digests(words, doc, head, lengths, shingles), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)), digest, arrays["bands"], arrays["sketch"]],
                    ["id", "n_shingles", "digest", "bands", "sketch"])

    return docs.mapInArrow(run, _SIGNED)


def exact_set(text: str, width: int = WIDTH) -> frozenset:
    w = bytes(LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]).split()
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*[w[j:] for j in range(width)]))


class _Sets:
    """Sets of the texts met last, oldest dropped first, of at most ``limit`` letters together."""

    def __init__(self, width: int, limit: int = 1 << 19):
        self.width, self.limit, self.size, self.held = width, limit, 0, {}

    def __call__(self, text: str) -> frozenset:
        found = self.held.pop(text, None)
        if found is None:
            found = exact_set(text, self.width)
            self.size += len(text)
            while self.held and self.size > self.limit:
                old = next(iter(self.held))
                self.size -= len(old)
                del self.held[old]
        self.held[text] = found
        return found


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """The ``(a, b)`` whose full sets have ``100 * intersection >= percent * union``. ``texts`` has ``id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(width)
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, t = sets(x), sets(y)
                both = len(s & t)
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            kept = b.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    # ordered by the leader's side, so that its set is made once in a row
    wide = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return wide.mapInArrow(run, "a long, b long")


def rare_prefixes(texts: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """``id, size, shingle, pos``: the shingles of every text of ``texts (id, text)`` by which it can meet a partner.

    Shingles are ordered by how many of the texts have them, rare ones first; ``pos`` counts from 0. Of two linked sets
    of sizes ``x`` and ``y``, which share at least ``o = percent * (x + y) / (100 + percent)`` shingles, the first common
    one lies at most ``x - o`` and ``y - o`` deep, so nothing deeper than the smallest partner allows is returned, nor
    are shingles that one text alone has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts_ in chunks(b.column(1)):
                shingles, size = shingle_sets(Words(texts_, lower=True), width)
                total = np.zeros(len(shingles) + 1, np.uint64)
                np.cumsum(mix(shingles), out=total[1:])
                end = np.cumsum(size)
                at = np.repeat(np.arange(len(size)), size)
                ids = b.column(0).slice(lo, hi - lo).take(pa.array(at))
                row = _signed(total[end] - total[end - size])  # rows that repeat an id stay apart
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(row[at]), pa.array(size[at].astype(np.int64)), pa.array(_signed(shingles))], ["id", "row", "size", "shingle"])

    held = materialise(texts.select("id", "text").mapInArrow(run, "id long, row long, size long, shingle long"))
    spread = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = held.join(spread, "shingle").groupBy("id", "row", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("list"))
    private = F.col("size") - F.size("list")
    depth = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1
    found = listed.select("id", "size", "list", private.alias("private"), (depth - private).cast("int").alias("depth")).where("depth > 0")
    return found.select("id", "size", "private", F.posexplode(F.slice("list", F.lit(1), F.col("depth"))).alias("at", "m")).select(
        "id", "size", "m.shingle", (F.col("private") + F.col("at")).alias("pos"))


def similar_sketches(pairs: DataFrame, sketches: DataFrame, min_estimate: float = MIN_ESTIMATE) -> DataFrame:
    """The ``(a, b)`` whose odd sketches estimate a similarity of ``min_estimate``."""
    a = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"))
    b = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"))
    differ = F.aggregate(
        F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    # J = 1 + bits / (4 samples) * ln(1 - 2 differing / bits)
    share = F.lit(1.0) - F.lit(2.0) * differ / SKETCH_BITS
    estimate = F.when(share > 0, 1 + F.lit(SKETCH_BITS / (4 * SAMPLES)) * F.log(share)).otherwise(F.lit(0.0))
    return pairs.join(a, "a").join(b, "b").where(estimate >= min_estimate).select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component`` (smallest id reachable) of every id in ``edges (a, b)``, by contraction.

    Each round every component points to its smallest neighbour, pointers are followed to their roots (twice as far with
    every jump), ids and edges are renamed by them, and edges inside a component go. At least half of the components
    that still have edges go in a round. Every step is a written table, so neither plan nor lineage grows.
    """
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    labels = materialise(ends.select("id", F.col("id").alias("component")))
    rest = materialise(edges.where("a <> b").select("a", "b").distinct())
    for _ in range(max_rounds):
        if rest.isEmpty():
            return labels
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialise(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a").withColumn("moved", F.lit(True)))
        while not point.where("moved").isEmpty():
            onward = point.select(F.col("a").alias("to"), F.col("to").alias("further"))
            point = materialise(point.drop("moved").join(onward, "to", "left").select(
                "a", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        labels = materialise(
            labels.join(point, F.col("component") == F.col("a"), "left").select("id", F.coalesce("to", "component").alias("component")))
        new_a = point.select(F.col("a").alias("x"), F.col("to").alias("new_a"))
        new_b = point.select(F.col("a").alias("y"), F.col("to").alias("new_b"))
        rest = materialise(
            rest.join(new_a, F.col("a") == F.col("x"), "left").join(new_b, F.col("b") == F.col("y"), "left")
            .select(F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b")).where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    raise ArithmeticError(f"components not closed after {max_rounds} rounds")


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _still_open(shared: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the buckets with several components: the members outside the largest, and all members."""
    located = materialise(shared.join(labels, "id", "left").select("bucket", "id", "n_shingles", F.coalesce("component", "id").alias("component")))
    mixed = located.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    members = materialise(located.join(mixed, "bucket", "left_semi"))
    biggest = (
        members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
        .agg(F.max(F.struct("n", "component")).alias("m")).select("bucket", F.col("m.component").alias("big")))
    members = materialise(members.join(biggest, "bucket"))
    other = members.select("bucket", F.col("id").alias("b"), F.col("n_shingles").alias("size_b"), F.col("component").alias("comp_b"), "big")
    return members.where("component <> big").drop("big"), other


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Shingles are ``words`` words (A-Z lower-cased) in a row, of a shorter text all its words; a text without words (null
    too) has none and is linked with nothing. Linked are documents whose sets have a similarity of ``percent``; ``component_id``
    is the smallest id reachable. Rows without an id are linked with nothing (null component, kept). Rows that repeat an
    id are joined into its component each by its own text. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(sign(source, words))
    # equal sets (by the SHA-256 of their shingles) are one class, named by its smallest id
    key = ["digest"]
    classes = materialise(
        signed.where("id is not null and n_shingles > 0").groupBy(*key).agg(F.min(F.struct("id", "n_shingles", "sketch", "bands")).alias("m"))
        .select(*key, "m.id", "m.n_shingles", "m.sketch", "m.bands"))
    member = classes.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = materialise(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = materialise(member.join(buckets, "bucket"))
    # the leader of a bucket: the member that meets most others over all its buckets, an original before its variants
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = shared.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("neg"), "n_shingles")).alias("m"))
    leader = ranked.select("bucket", (-F.col("m.neg")).alias("leader"), F.col("m.n_shingles").alias("leader_size"))
    sketches = materialise(classes.join(shared.select("id").distinct(), "id", "left_semi").select("id", "sketch"))
    first = (
        shared.join(leader, "bucket").where("id <> leader").where(_sizes_fit("n_shingles", "leader_size", percent))
        .select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct())
    first = materialise(similar_sketches(first, sketches))
    texts = materialise(source.join(sketches.select("id"), "id", "left_semi"))
    linked = materialise(confirm(first, texts, percent, words))
    labels = components(linked)
    # members outside the largest component of their bucket, with some of its members
    few, other = _still_open(shared, labels)
    picks = [F.max(F.struct(F.xxhash64("b", F.lit(j)).alias("h"), "b", "size_b")).alias(f"m{j}") for j in range(LEADERS)]
    leaders = other.where("comp_b = big").groupBy("bucket").agg(*picks).select(
        "bucket", F.explode(F.array_distinct(F.array(*[F.struct(f"m{j}.b", f"m{j}.size_b") for j in range(LEADERS)]))).alias("m"))
    tried = first.select(*_ordered("a", "b"))
    second = (
        few.join(leaders, "bucket").where(_sizes_fit("n_shingles", "m.size_b", percent)).select(*_ordered("id", "m.b"))
        .distinct().join(tried, ["a", "b"], "left_anti"))
    second = materialise(similar_sketches(second, sketches))
    if not second.isEmpty():
        linked = materialise(linked.union(confirm(second, texts, percent, words)))
        labels = components(linked)
        few, other = _still_open(shared, labels)
        tried = tried.union(second)
    # all pairs that are left: different components, one of them not the largest of a bucket, that share a rare shingle
    place = other.select(F.col("b").alias("id"), "comp_b").distinct()
    minor = few.select("id").distinct().withColumn("minor", F.lit(True))
    open_texts = texts.join(place.select("id").distinct(), "id", "left_semi")
    tokens = materialise(
        rare_prefixes(open_texts, percent, words).join(place, "id").join(minor, "id", "left")
        .select("shingle", F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"), "comp_b", F.coalesce("minor", F.lit(False)).alias("minor_b")))
    small = tokens.where("minor_b").select(
        "shingle", F.col("b").alias("id"), F.col("size_b").alias("n_shingles"), F.col("pos_b").alias("pos"), F.col("comp_b").alias("component"))
    needed = percent * (F.col("n_shingles") + F.col("size_b"))
    can_link = ((100 + percent) * (F.col("n_shingles") - F.col("pos")) >= needed) & ((100 + percent) * (F.col("size_b") - F.col("pos_b")) >= needed)
    third = (
        small.join(tokens, "shingle").where("component <> comp_b and (not minor_b or id < b)").where(can_link)
        .select(*_ordered("id", "b")).distinct().join(tried, ["a", "b"], "left_anti"))
    third = materialise(similar_sketches(third, sketches))
    if not third.isEmpty():
        linked = materialise(linked.union(confirm(third, texts, percent, words)))
        labels = components(linked)
    named = materialise(classes.select(*key, F.col("id").alias("class_id")).join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
                        .select(*key, F.coalesce("component", "class_id").alias("component")))
    rows = signed.select("id", "n_shingles", *key).join(named, key, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all columns: one document of each group.

    Shingles have five words: the two of ``WIDTH`` belong to op7's own query only.
    """
    found = near_duplicates(docs, id_col, text_col, percent, words)
    drop = found.where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(drop, F.col(id_col) == F.col("__id"), "left_anti")
