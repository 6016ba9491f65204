"""Words of many texts at once: Arrow strings to flat numpy arrays of word bounds and 64-bit word hashes.

Texts are handled in chunks of about ``CHUNK`` bytes (always whole texts), so memory follows the longest text, not the
batch. White space is ``[\\x20\\x09-\\x0D]``; null text counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
MAX_DOCS = 4096  # texts of a chunk: their number fits the top 12 bits of a sort key
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_LONG = 1024  # spans beyond so many bytes are hashed and compared one by one


def byte_view(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as unsigned integers (zeros follow the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _span(view: np.ndarray, at: int, length: int) -> bytes:
    return view.base[at:at + length].tobytes()


def hash_spans(view: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, block by block. Equal hashes don't prove equal spans; see ``same_spans``."""
    h = mix(length.astype(U) * U(_BASE) ^ (view[start] & _MASK[np.minimum(length, 8)]))
    at, k = np.flatnonzero(length > 8), 8
    while len(at) and k < _LONG:
        left = np.minimum(length[at] - k, 8)
        h[at] = mix(h[at] * U(_BASE) ^ (view[start[at] + k] & _MASK[left]))
        k += 8
        at = at[length[at] > k]
    for i in at.tolist():
        rest = hashlib.blake2b(_span(view, int(start[i]) + k, int(length[i]) - k), digest_size=8).digest()
        h[i] = mix(h[i:i + 1] * U(_BASE) ^ np.frombuffer(rest, U))[0]
    return h


def same_spans(view: np.ndarray, start: np.ndarray, other: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes at ``start`` of one text and at ``at`` of another are the same, for each pair."""
    same = ((view[start] ^ other[at]) & _MASK[np.minimum(length, 8)]) == 0
    open_, k = np.flatnonzero(same & (length > 8)), 8
    while len(open_) and k < _LONG:
        left = np.minimum(length[open_] - k, 8)
        equal = ((view[start[open_] + k] ^ other[at[open_] + k]) & _MASK[left]) == 0
        same[open_[~equal]] = False
        k += 8
        open_ = open_[equal & (length[open_] > k)]
    for i in open_.tolist():
        n = int(length[i]) - k
        same[i] = _span(view, int(start[i]) + k, n) == _span(other, int(at[i]) + k, n)
    return same


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys as groups, smallest key first: a member of each, the group of every key, and the groups' sizes."""
    order = np.argsort(key)
    ordered = key[order]
    opens = np.ones(len(key), bool)
    opens[1:] = ordered[1:] != ordered[:-1]
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(opens) - 1
    heads = np.flatnonzero(opens)
    return order[heads], group, np.diff(np.append(heads, len(key)))


def number_spans(view: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 that are equal exactly where the spans' bytes are, and for each number a span that has it.

    Spans are sorted by their hashes ``code``, then compared with the first one of their hash; those that differ from it
    are told apart by their bytes.
    """
    first, number, _ = grouped(code)
    lead = first[number]
    same = length == length[lead]
    same[same] = same_spans(view, start[same], view, start[lead[same]], length[same])
    if not same.all():
        fresh: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(~same).tolist():
            word = _span(view, int(start[i]), int(length[i]))
            if word not in fresh:
                fresh[word] = len(first) + len(extra)
                extra.append(i)
            number[i] = fresh[word]
        first = np.r_[first, extra]
    return number, first


def strings(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another and the offsets of each (one more than there are texts)."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """``(first row, row after the last, texts)`` for runs of whole texts."""
    texts = strings(column)
    if not len(texts):
        return
    _, off = raw(texts)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1
        hi = min(max(hi, lo + 1), lo + MAX_DOCS, len(texts))
        yield lo, hi, texts.slice(lo, hi - lo)
        lo = hi


class Words:
    """Words of a chunk. ``first[d]:first[d + 1]`` are the words of text ``d``; ``code`` their 64-bit hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, self.off = raw(texts)
        self.data = LOWER[data] if lower else data
        n = len(data)
        space = SPACE[self.data]
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:], after[:-1] = space if n else [], False
        after[:max(n - 1, 0)] = space[1:]
        after[max(n - 1, 0)] = True
        before[self.off], after[self.off[1:][self.off[1:] > 0] - 1] = True, True
        self.start = np.flatnonzero(~space & before[:n])
        self.end = np.flatnonzero(~space & after[:n]) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.first[-1] = len(self.start)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    @cached_property
    def view(self) -> np.ndarray:
        return byte_view(self.data)

    @cached_property
    def code(self) -> np.ndarray:
        return hash_spans(self.view, self.start, self.end - self.start)

    @cached_property
    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """A number per word, equal exactly for equal words, and for each number a word that has it."""
        return number_spans(self.view, self.start, self.end - self.start, self.code)

    def same_words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words at ``a`` and at ``b`` are the same, for each pair."""
        n = self.end[a] - self.start[a]
        same = n == self.end[b] - self.start[b]
        same[same] = same_spans(self.view, self.start[a[same]], self.view, self.start[b[same]], n[same])
        return same

    def repeats(self, k: int) -> np.ndarray:
        """For each position whether the ``k`` words from it on stand at another position of the same text as well.

        Windows are sorted by their hashes; neighbours are compared word by word. Should two different windows share a
        hash, the windows of the chunk are numbered exactly instead.
        """
        grams, valid = self.grams(k, self.code)
        at = np.flatnonzero(valid)
        key = mix(grams[at] ^ mix(self.doc[at].astype(U) * U(_BASE)))
        order = np.argsort(key, kind="stable")
        twin = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        a, b = at[order[twin]], at[order[twin + 1]]
        same = self.doc[a] == self.doc[b]
        for j in range(k):
            same = same & self.same_words(a + j, b + j)
        hit = np.zeros(len(self.doc), bool)
        if same.all():
            hit[a], hit[b] = True, True
        elif len(at):
            n, size = self.numbers[0], len(self.numbers[1])
            rank = self.doc[at].astype(np.int64)
            for j in range(k):
                _, rank = np.unique(rank * size + n[at + j], return_inverse=True)
            hit[at] = np.bincount(rank)[rank] > 1
        return hit

    def grams(self, k: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words from each position on, and whether they lie in one text."""
        n = max(len(code) - k + 1, 0)
        h = code[:n].copy()
        for j in range(1, k):
            h = h * U(_BASE) + code[j:j + n]
        return mix(h), np.arange(n) + k <= self.first[self.doc[:n] + 1]
