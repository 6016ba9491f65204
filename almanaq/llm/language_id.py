"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds (multiplies) its letters' vectors, each permuted
(rotated) by its place; a document bundles (adds) its trigrams; a language's prototype bundles its documents. The
prediction is the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package
from .wordgrid import CHUNK, U, mix, strings

DIMENSION = 1024
UNKNOWN = "und"
_SEED = 0xD1342543DE82EF95
_STEP = 0x9E3779B97F4A7C15
_DOCS = 192  # documents of a group
_BLOCK = 2048  # distinct trigrams whose vectors are held at once


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_signs(letters: np.ndarray, dimension: int) -> np.ndarray:
    """Sign bits (letters x dimension, 1 for -1) of the vectors of letters, given as code points; 0 is the gap between
    words. They come from a mixing function, so they are the same on every machine and many are made at once."""
    words = np.arange(-(-dimension // 64), dtype=U)
    seeds = mix(letters.astype(U)[:, None] * U(_SEED) + words[None, :] * U(_STEP) + U(1))
    return np.unpackbits(mix(seeds).astype("<u8").view(np.uint8), axis=1)[:, :dimension]


def letter_vector(letter: int, dimension: int) -> np.ndarray:
    return 1 - 2 * letter_signs(np.array([letter]), dimension)[0].astype(np.int8)


def trigram_counts(low: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every distinct trigram of lower-cased texts (its three code points), and its place and text for every letter.

    A trigram is a letter with its two neighbours; a neighbour that isn't a letter is a gap. The first and last character
    of a text are neighbours only.
    """
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in low])
    points = np.where(_letters()[points], points, 0)
    inner = points != 0
    ends = np.cumsum(size)
    inner[ends - 1] = inner[ends - size] = False
    middle = np.flatnonzero(inner)
    doc = np.searchsorted(ends, middle, "right")
    present = np.bincount(points) > 0
    alphabet, index = np.flatnonzero(present), np.cumsum(present)[points] - 1
    size = len(alphabet)
    code = (index[middle - 1].astype(np.int64) * size + index[middle]) * size + index[middle + 1]
    if size ** 3 <= 1 << 21:
        used = np.flatnonzero(np.bincount(code, minlength=1))
        rank = np.zeros(size ** 3, np.int64)
        rank[used] = np.arange(len(used))
        at = rank[code]
    else:
        used, at = np.unique(code, return_inverse=True)
    return alphabet[np.stack([used // size ** 2, used // size % size, used % size])], at, doc


def _add_bundles(total: np.ndarray, low: list[str]) -> np.ndarray:
    """Adds to each text's row the bundle of its trigrams, ``_BLOCK`` distinct trigrams at a time; their number per text.

    Sums are whole numbers below 2 to the 24th per block, so they are exact and don't depend on how texts are grouped.
    """
    grams, at, doc = trigram_counts(low)
    n, dimension = total.shape
    pair = at * n + doc
    if grams.shape[1] * n <= 1 << 22:
        dense, held, counts = np.bincount(pair, minlength=grams.shape[1] * n), None, None
    else:
        dense, (held, counts) = None, np.unique(pair, return_counts=True)
    for lo in range(0, grams.shape[1], _BLOCK):
        part = grams[:, lo:lo + _BLOCK]
        width = part.shape[1]
        letters, where = np.unique(part, return_inverse=True)
        signs, where = letter_signs(letters, dimension), where.reshape(part.shape)
        bound = np.roll(signs, 2, 1)[where[0]] ^ np.roll(signs, 1, 1)[where[1]] ^ signs[where[2]]
        if dense is not None:
            here = dense[lo * n:(lo + width) * n]
        else:
            a, z = np.searchsorted(held, (lo * n, (lo + width) * n))
            here = np.zeros(width * n, np.int64)
            here[held[a:z] - lo * n] = counts[a:z]
        total += here.reshape(width, n).T.astype(np.float32) @ (1 - 2 * bound.astype(np.float32))
    return np.bincount(doc, minlength=n)


def document_bundles(texts: list[str], dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundle (sum of bound trigrams) and number of letters of each text. A long text is added up in parts."""
    low = [f" {t.lower()} " for t in texts]
    total, n = np.zeros((len(low), dimension)), np.zeros(len(low), np.int64)
    if len(low) == 1:  # a letter at a cut is the inner one of one part and a neighbour in the other
        for at in range(0, len(low[0]) - 2, CHUNK):
            n += _add_bundles(total, [low[0][at:at + CHUNK + 2]])
    elif low:
        n += _add_bundles(total, low)
    return total, n


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo >= _DOCS or size + len(t) > CHUNK):
            yield lo, i
            lo = i
            size = 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def held_out(id_: Column) -> Column:
    """True for the third of the documents that is never learned from; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def train_prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimension: int = DIMENSION) -> DataFrame:
    """``lang, vector`` from all rows with a language: the sum of their documents' bundles (``dimension`` numbers).

    A document weighs 1, whatever its length. Rows are added up per task and language before the shuffle. Rows without language or letters add nothing.
    """
    ship_package(docs.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), strings(b.column(1)).to_pylist()
            for lo, hi in _groups(texts):
                bundles, n = document_bundles(texts[lo:hi], dimension)
                shares = bundles / np.maximum(n, 1)[:, None]
                for lang in sorted({x for x, k in zip(langs[lo:hi], n.tolist()) if k}):
                    total[lang] = total.get(lang, 0) + shares[[x == lang for x in langs[lo:hi]]].sum(0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "part"])

    parts = docs.where(F.col(lang_col).isNotNull()).select(lang_col, text_col).mapInArrow(bundle, "lang string, part array<double>")
    sums = parts.select("lang", F.posexplode("part").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))


def predict_language(
        docs: DataFrame, prototypes: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimension: int = DIMENSION) -> DataFrame:
    """``doc_id, lang_pred, score`` per row of ``docs``; the score is the best cosine, cut to 0..1.

    A text without a letter (null and empty ones too) is ``und`` with score 0, and so is every text when nothing was
    learned. Equal cosines: the first language by name. Null ids pass through; rows are judged one by one. A very long
    text is added up a million characters at a time, so beyond the text itself memory stays below some 300 MB whatever
    its length and letters.
    """
    ship_package(docs.sparkSession)
    told = _teller(prototypes, dimension)
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = told(strings(b.column(1)).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def _teller(prototypes: DataFrame, dimension: int) -> Callable[[list[str]], tuple[list[str], list[float]]]:
    """A function from texts to their languages and scores."""
    learned = sorted((r["lang"], r["vector"]) for r in prototypes.collect())  # a row per language
    names = [lang for lang, _ in learned]
    matrix = np.array([v for _, v in learned], np.float64).reshape(len(names), dimension)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)

    def tell(texts: list[str]) -> tuple[list[str], list[float]]:
        langs: list[str] = []
        scores: list[float] = []
        for lo, hi in _groups(texts):
            if not names:
                langs += [UNKNOWN] * (hi - lo)
                scores += [0.0] * (hi - lo)
                continue
            bundles, n = document_bundles(texts[lo:hi], dimension)
            known, norm = n > 0, np.linalg.norm(bundles, axis=1, keepdims=True)
            cosine = bundles @ matrix.T / np.where(norm > 0, norm, 1)
            best = cosine.argmax(1)
            langs += [names[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())]
            scores += np.where(known, np.clip(cosine.max(1), 0, 1), 0).round(6).tolist()
        return langs, scores

    return tell


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out, predicts all: ``doc_id, held_out, lang_pred, score``."""
    prototypes = materialise(train_prototypes(docs.where(~held_out(F.col(id_col))), lang_col, text_col))
    return predict_language(docs, prototypes, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.05) -> DataFrame:
    """The rows of ``docs`` whose language could be told, with all columns: not ``und``, and a cosine of ``min_score``.
    Beyond ``und`` that rejects little: cosines of unrelated vectors have a standard deviation of ``1 / sqrt(dimension)``
    and the score is the largest of all languages, so texts of an unlearned script may pass. A higher bound would reject
    very short texts, whose cosines are low too. Every row is judged by its own text, in the task that reads it: nothing
    is shuffled.
    """
    prototypes = materialise(train_prototypes(docs.where(~held_out(F.col(id_col))), lang_col, text_col))
    told, at = _teller(prototypes, DIMENSION), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = told(strings(b.column(at)).to_pylist())
            yield b.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
