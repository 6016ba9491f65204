"""Pre-tokenisation of many texts at once, and a table of pieces that were encoded before.

A piece is what the tokenizer's split pattern matches: a contraction, a run of letters, of digits, or of other
characters. Runs come from one class per code point; contractions and white space are put right afterwards.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .wordgrid import byte_view, hash_spans, number_spans, same_spans

OTHER, LETTER, NUMBER, SPACE = range(4)
#: The characters of ``\s`` in the tokenizers' patterns.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What follows the apostrophe of a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE)] = SPACE
    return table


class Pieces:
    """Pieces of some texts: ``start``, ``end`` in ``joined``, ``doc``.

    ``spaced``: a space before a run belongs to it and white space is kept (byte-level pattern). Otherwise white space is
    dropped and every digit is a piece (word pattern).
    """

    def __init__(self, texts: list[str], spaced: bool):
        self.joined = "".join(texts)
        points = self.points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        kind = classes()[points]
        opens = np.ones(n + 1, bool)
        opens[1:n] = kind[1:] != kind[:-1]
        opens[off] = True
        first_of_text = np.zeros(n + 1, bool)
        first_of_text[off] = True
        if not spaced:
            opens[:n] |= kind == NUMBER
        padded = np.zeros(n + 3, np.uint32)
        padded[:n] = points
        quotes = np.flatnonzero((points == 0x27) & opens[:n])
        if spaced:
            quotes = quotes[first_of_text[quotes] | (points[quotes - 1] != 0x20)]
        quotes = quotes[~first_of_text[quotes + 1]]
        one, two = padded[quotes + 1], padded[quotes + 2]
        for tail in CONTRACTIONS:
            if len(tail) == 1:
                found = quotes[one == ord(tail)]
            else:
                found = quotes[(one == ord(tail[0])) & (two == ord(tail[1]))]
                found = found[~first_of_text[found + 2]]
            opens[found + 1] = False
            opens[found + 1 + len(tail)] = True
        if spaced:
            ends = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first_of_text[1:n]) + 1 if n else np.zeros(0, np.int64)
            opens[ends - 1] = True
            opens[ends[points[ends - 1] == 0x20]] = False
        bounds = np.flatnonzero(opens[:n])
        self.start, self.end = bounds, np.r_[bounds[1:], n] if n else bounds
        if not spaced:
            keep = kind[self.start] != SPACE
            self.start, self.end = self.start[keep], self.end[keep]
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.n_docs = len(texts)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces as bytes: a view of them, where each starts and how long it is."""
        return byte_view(self.points.view(np.uint8)), self.start * 4, (self.end - self.start) * 4


class PieceTable:
    """Ids of pieces met before, found by hash and compared byte by byte; emptied when it holds ``limit`` pieces.

    Pieces of more than ``LONGEST`` letters, and a piece whose hash another one has taken, are encoded anew each time.
    """

    LONGEST = 64

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self._empty()

    def _empty(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.words, self.used = np.zeros(1 << 16, np.uint8), 0
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _store(self, view: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Keeps the bytes of new pieces; the buffer doubles, so that adding is linear over all."""
        total = int(length.sum())
        if self.used + total + 8 > len(self.words):
            self.words = np.concatenate([self.words[:self.used], np.zeros(self.used + total + (1 << 16), np.uint8)])
        first = np.cumsum(length) - length
        where = np.repeat(start - first, length) + np.arange(total)
        self.words[self.used:self.used + total] = view.base[where]
        self.at, self.length = np.r_[self.at, self.used + first], np.r_[self.length, length]
        self.used += total

    def _known(self, keys: np.ndarray, view: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each piece in the table (-1: not there) and whether its hash is taken."""
        at = np.searchsorted(self.keys, keys)
        taken = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        taken[inside] = self.keys[at[inside]] == keys[inside]
        slot = np.full(len(keys), -1)
        slot[taken] = self.slots[at[taken]]
        here = np.flatnonzero(taken)
        here = here[self.length[slot[here]] == length[here]]
        own = np.ndarray((len(self.words) - 7,), "<u8", self.words, strides=(1,))
        good = here[same_spans(view, start[here], own, self.at[slot[here]], length[here])]
        found = np.full(len(keys), -1)
        found[good] = slot[good]
        return found, taken

    def lookup(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each text."""
        if not len(pieces.start):
            return np.zeros(0, np.int32), np.zeros(pieces.n_docs, np.int64)
        view, start, length = pieces.spans()
        code = hash_spans(view, start, length)
        number, lead = number_spans(view, start, length, code)
        if len(self.keys) > self.limit:
            self._empty()
        slot, taken = self._known(code[lead], view, start[lead], length[lead])
        new = np.flatnonzero(slot < 0)
        offsets, ids = self.offsets, self.ids
        if len(new):
            where, text = lead[new], pieces.joined
            fresh, counts = self.encode([text[a:b] for a, b in zip(pieces.start[where].tolist(), pieces.end[where].tolist())])
            fresh = fresh.astype(np.int32)
            slot[new] = np.arange(len(new)) + len(offsets) - 1
            offsets = np.concatenate([offsets, offsets[-1] + np.cumsum(counts)])
            ids = np.concatenate([ids, fresh])
            _, once = np.unique(code[where], return_index=True)
            stays = np.zeros(len(new), bool)
            stays[once] = True
            stays &= ~taken[new] & (length[where] <= 4 * self.LONGEST)
            kept = new[stays]
            own = np.arange(len(kept)) + len(self.offsets) - 1
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts[stays])])
            self.ids = np.concatenate([self.ids, fresh[np.repeat(stays, counts)]])
            self._store(view, start[lead[kept]], length[lead[kept]])
            keys = code[lead[kept]]
            order = np.argsort(keys, kind="stable")
            at = np.searchsorted(self.keys, keys[order])
            self.keys, self.slots = np.insert(self.keys, at, keys[order]), np.insert(self.slots, at, own[order])
        slot = slot[number]
        count = offsets[slot + 1] - offsets[slot]
        where = np.repeat(offsets[slot] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        per_text = np.bincount(pieces.doc, weights=count, minlength=pieces.n_docs).astype(np.int64)
        return ids[where], per_text


def encode_texts(texts: list[str], table: PieceTable, spaced: bool, special: dict[str, int], normalise: Callable[[str], str] | None = None):
    """Flat ids and their number per text. Special tokens inside a text cut it and become their id."""
    plain, marks = [], []
    pieces_of = np.ones(len(texts), np.int64)
    if special and any("<|" in t for t in texts):
        import re

        pattern = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        for d, t in enumerate(texts):
            found = [special[m] for m in pattern.findall(t)]
            parts = pattern.split(t)
            pieces_of[d] = len(parts)
            plain += parts
            marks += [*found, -1]
    else:
        plain, marks = texts, None
    ids, counts = table.lookup(Pieces([normalise(t) for t in plain] if normalise else plain, spaced))
    if marks is None:
        return ids, counts
    marks = np.array(marks, np.int64)
    put = np.flatnonzero(marks >= 0)
    ids = np.insert(ids, np.cumsum(counts)[put], marks[put])
    return ids, np.add.reduceat(counts + (marks >= 0), np.cumsum(pieces_of) - pieces_of) if len(texts) else counts
