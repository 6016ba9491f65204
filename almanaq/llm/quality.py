"""Line-first cleaning: rules per line, removal of the lines that fail, rejection of texts that lose too much."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ship_package
from .wordgrid import SPACE, Words, chunks

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: Fixed word lists of the line rules (lower case).
NAVIGATION = ("home", "menu", "next", "previous", "back to top", "skip to content", "sign in", "log in", "register", "search", "share this", "read more")
BOILERPLATE = ("cookie policy", "privacy policy", "terms of service", "terms of use", "all rights reserved", "enable javascript", "lorem ipsum", "subscribe to our newsletter")


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20  # words in repeated windows, of all words
    window: int = 5
    max_symbol_share: float = 0.3  # symbols in a line, of its characters without white space
    min_letter_share: float = 0.5  # letters and their marks in a line, of its characters without white space
    min_kept_share: float = 0.5  # of the words, after the failing lines are gone


_LETTER = regex.compile(r"[\p{L}\p{M}]")  # many scripts write vowels as marks
_CUT = ("...", "…")
_BOILER = regex.compile("|".join(map(regex.escape, BOILERPLATE)))
_NAVIGATION = frozenset(NAVIGATION)
_ENDS = " \t\r\x0b\x0c|>-»:/.·•"
_AFTER = " \t\r\x0b\x0c\"')]»”’"  # may follow the end of a sentence


def line_fails(line: str, rules: Rules) -> str | None:
    """Name of the first rule that a line with a word breaks, else None."""
    low = line.strip(_ENDS).lower()
    if low in _NAVIGATION or (low.count("|") >= 2 and all(p.strip() in _NAVIGATION for p in low.split("|"))):
        return "navigation"
    if _BOILER.search(low):
        return "boilerplate"
    if line.rstrip(_AFTER).endswith(_CUT):
        return "cut off"
    solid = "".join(line.split())
    marks = sum(map(solid.count, "#*$%&|<>{}~^_=\\"))
    if marks > rules.max_symbol_share * len(solid):
        return "punctuation"
    if len(_LETTER.findall(solid)) < rules.min_letter_share * len(solid):
        return "punctuation"
    return None


def clean_text(text: str, rules: Rules) -> tuple[str, int, int, int]:
    """Cleaned text, number of repeated lines, of failing lines, and of words left. Repeats of a line fail too."""
    seen: set[str] = set()
    left, repeated, failing, words = [], 0, 0, 0
    for line in text.split("\n"):
        n = len(_ascii_words(line))
        if not n:
            left.append(line)
            continue
        again = line in seen
        repeated += again
        seen.add(line)
        if again or line_fails(line, rules):
            failing += 1
        else:
            left.append(line)
            words += n
    return "\n".join(left), repeated, failing, words


def _ascii_words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").split()  # bytes.split(): [\x20\x09-\x0D] only


def repeated_words(words: Words, window: int) -> np.ndarray:
    """Per text: words inside windows that occur twice or more in it."""
    at = np.flatnonzero(words.repeats(window))
    edge = np.zeros(len(words.doc) + window + 1, np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    covered = np.cumsum(edge)[:len(words.doc)] > 0
    return np.bincount(words.doc[covered], minlength=len(words.n))


def _rate(texts: pa.Array, rules: Rules) -> dict[str, list]:
    w = Words(texts)
    points = (w.data & 0xC0) != 0x80
    in_word = ~SPACE[w.data]

    def per_text(mask):
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[w.off[1:]] - total[w.off[:-1]]

    cleaned = [clean_text(t, rules) for t in texts.to_pylist()]
    repeat = repeated_words(w, rules.window)
    base = (w.n < rules.min_words) | (100 * repeat > rules.max_repeat_percent * w.n)
    left = np.array([c[3] for c in cleaned], np.int64)
    return {
        "n_words": w.n, "word_chars": per_text(points & in_word), "n_symbols": per_text(SYMBOLS[w.data]),
        "n_dup_lines": np.array([c[1] for c in cleaned], np.int64), "n_repeat_words": repeat, "base_failed": base,
        "kept": ~base & (left >= rules.min_kept_share * w.n), "n_failed_lines": np.array([c[2] for c in cleaned], np.int64),
        "n_words_left": left, "clean_text": [c[0] for c in cleaned]}


_TYPES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "n_failed_lines": pa.int64(), "n_words_left": pa.int64(), "clean_text": pa.string()}


def line_first_cleaning(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts, ``base_failed``, ``kept`` and the cleaned text.

    A line with a word fails as navigation, boilerplate, cut off (it ends in an ellipsis, as teasers do), mostly
    punctuation or digits, or as a repeat of an earlier line; failing lines are removed. A text is rejected when it has too few words, too many words in repeated windows, or when
    less than ``min_kept_share`` of its words are left. Null text counts as empty (rejected), null ids pass through, and
    rows are judged one by one, so repeats and ties don't matter. Other columns are not read. A very long text takes time
    and memory in proportion to its length, some 60 bytes per byte.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in chunks(b.column(1)):
                found = _rate(texts, rules)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), *(pa.array(found[k], t) for k, t in _TYPES.items())], ["doc_id", *_TYPES])

    names = {"int64": "long", "bool": "boolean", "string": "string"}
    return docs.select(id_col, text_col).mapInArrow(rate, f"doc_id {kind}, " + ", ".join(f"{k} {names[str(t)]}" for k, t in _TYPES.items()))
