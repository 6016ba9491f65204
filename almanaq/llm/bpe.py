"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up every neighbouring pair by binary search over the
sorted pair keys, finds the lowest rank of each word, and merges that pair everywhere in the word at once, left to
right. Words without a known pair leave the array. Only words not met before are merged; see ``pieces.PieceTable``.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ship_package
from .pieces import PieceTable, encode_texts
from .wordgrid import chunks

_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """Printable stand-in of every byte in a byte-level vocabulary: itself where printable, else from 256 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary as flat tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(names) + 1
        self.names = pa.array([names.get(i, "") for i in range(self.size)], pa.string())
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number per word; no word is empty."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), size)
        done_ids, done_words = [], []
        while len(symbols):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(symbols), _NONE)
            at = np.flatnonzero(word[1:] == word[:-1])
            key = symbols[at] * self.size + symbols[at + 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            rank[at[hit]] = self.ranks[place[hit]]
            lowest = np.minimum.reduceat(rank, heads)
            lengths = np.diff(np.r_[heads, len(symbols)])
            finished = np.repeat(lowest == _NONE, lengths)
            done_ids.append(symbols[finished])
            done_words.append(word[finished])
            left = np.flatnonzero((rank == np.repeat(lowest, lengths)) & ~finished)
            # pairs that overlap (a run of one symbol): every second one, from the left
            run = np.cumsum(np.r_[True, np.diff(left) != 1]) if len(left) else left
            first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(left) else left
            nth = np.arange(len(left)) - np.repeat(first, np.diff(np.r_[first, len(left)])) if len(left) else left
            left = left[nth % 2 == 0]
            if len(left):
                key = symbols[left] * self.size + symbols[left + 1]
                symbols[left] = self.made[np.searchsorted(self.keys, key)]
            keep = ~finished
            keep[left + 1] = False
            symbols, word = symbols[keep], word[keep]
        ids, owner = np.concatenate(done_ids or [np.zeros(0, np.int64)]), np.concatenate(done_words or [np.zeros(0, np.int64)])
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of id sequences: the tokens' names joined by spaces."""
        names = self.names.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names), " ")


def normalise(text: str) -> str:
    """Composed form, lower case letter by letter (a final sigma is no exception). White space of any kind only parts
    words, so it needs no replacing."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(2)
def _tables(path: str) -> tuple[Vocabulary, PieceTable]:
    v = Vocabulary(path)
    return v, PieceTable(lambda words: v.merge([w.encode("utf-8", "surrogatepass") for w in words]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` per row of ``docs``: the token ids of the whole text and the text decoded from them.

    Null text counts as empty (no ids, empty text); null ids pass through; rows are encoded one by one; other columns are
    not read. ``path`` names the vocabulary file, which every executor must have.
    """
    ship_package(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = _tables(path)
        for b in batches:
            for lo, hi, texts in chunks(b.column(1)):
                ids, counts = encode_texts(texts.to_pylist(), table, False, vocabulary.special, normalise)
                offsets = np.zeros(len(counts) + 1, np.int64)
                np.cumsum(counts, out=offsets[1:])
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), column, vocabulary.decode(ids, offsets)], ["doc_id", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(encode, f"doc_id {kind}, ids array<int>, decoded string")
