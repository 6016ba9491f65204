"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Shallow trees are boosted in a cycle over the features, one feature at a time,
each tree splitting the bins of its feature only; their sum is one lookup table per feature. Then trees over two features
each are boosted for the pairs that explain most of what is left. A score is the sum of the tables' entries, looked up
for all texts of a batch at once.

The tables are learned from a bounded sample of labelled rows (``FitRules.max_rows``); features and scores are computed
for every row and every whole text, in Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .wordgrid import SPACE, Words, chunks

THRESHOLD = 0.3  # fixed value: scores from here on predict label 1


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _bytes("abcdefghijklmnopqrstuvwxyz")
_LOWER[128:] = True  # letters of other scripts have no case here
_DIGIT = _bytes("0123456789")
_STOP = _bytes(".!?")
_COMMA = _bytes(",;:")
_LOUD = _bytes("!?")
_BAR = _bytes("|")
_QUOTE = _bytes("\"'()-")
_MARK = ~(_UPPER | _LOWER | _DIGIT | SPACE | _STOP | _COMMA | _QUOTE | _BAR)

FEATURES = (
    "words", "word_length", "longest_word", "upper", "digits", "marks", "bars", "loud", "stops", "commas", "distinct_words",
    "same_as_before", "repeated_windows", "repeated_lines", "words_per_line", "ended_lines", "upper_words", "one_letter_words")


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text, in the order of ``FEATURES``; all zero for a text without a word.

    Shares are of the bytes without white space, of the words, or of the lines with a word. Words are told apart by their
    bytes, never by a hash.
    """
    w = Words(texts)
    n_texts, data = len(w.n), w.data

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[w.off[1:]] - total[w.off[:-1]]

    def of_words(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=values, minlength=n_texts)

    n = np.maximum(w.n, 1).astype(np.float64)
    solid = np.maximum(count(~SPACE[data]), 1).astype(np.float64)
    length = w.end - w.start
    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, w.doc, length)
    number = w.numbers[0]
    pair = np.unique(w.doc.astype(np.int64) * (len(w.numbers[1]) + 1) + number)
    distinct = np.bincount((pair // (len(w.numbers[1]) + 1)).astype(np.int64), minlength=n_texts)
    again = np.zeros(len(number), bool)
    again[1:] = (number[1:] == number[:-1]) & (w.doc[1:] == w.doc[:-1])
    edge = np.zeros(len(number) + 6, np.int64)
    at = np.flatnonzero(w.repeats(5))
    edge[at] += 1
    edge[at + 5] -= 1
    windows = of_words(np.cumsum(edge)[:len(number)] > 0)
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=upper[1:])
    capitals = (upper[w.end] - upper[w.start]) * 2 > length
    # lines: runs of words without a line break between them; a line's last byte tells how it ends
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x0A, out=breaks[1:])
    line = breaks[w.start]
    opens = np.ones(len(number), bool)
    opens[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    heads = np.flatnonzero(opens)
    tails = np.r_[heads[1:], len(number)][:len(heads)] - 1
    lines = np.bincount(w.doc[heads], minlength=n_texts)
    ended = np.bincount(w.doc[heads], weights=_STOP[data[w.end[tails] - 1]] if len(tails) else None, minlength=n_texts)
    repeated = np.zeros(n_texts)
    seen: dict[tuple, int] = {}
    spread = np.maximum(lines, 1)
    for h, t in zip(heads[lines[w.doc[heads]] > 1].tolist(), tails[lines[w.doc[heads]] > 1].tolist()):
        key = (int(w.doc[h]), number[h:t + 1].tobytes())
        repeated[w.doc[h]] += key in seen
        seen[key] = h
    columns = [
        np.log1p(w.n), of_words(length) / n, np.log1p(longest), count(_UPPER[data]) / solid, count(_DIGIT[data]) / solid,
        count(_MARK[data]) / solid, count(_BAR[data]) / solid, count(_LOUD[data]) / solid, count(_STOP[data]) / n, count(_COMMA[data]) / n,
        distinct / n, of_words(again) / n, windows / n, repeated / spread, np.log1p(w.n / spread), ended / spread, of_words(capitals) / n,
        of_words(length == 1) / n]
    return np.where((w.n > 0)[:, None], np.stack(columns, 1), 0.0)


@dataclass(frozen=True)
class FitRules:
    max_rows: int = 20_000  # labelled rows learned from: those with the smallest hashes of their ids
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 8
    rounds: int = 120  # cycles over all features, then over all pairs
    rate: float = 0.1
    leaves: int = 3
    min_rows: int = 20  # of a leaf
    ridge: float = 1.0
    held_share: int = 6  # every n-th row of the sample only decides when to stop


@dataclass
class Gam:
    """Lookup tables: ``edges[f]`` cut feature f into bins, ``tables[f]`` has an entry per bin, ``pairs`` tables of two."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(cut, x[:, f], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def _leaf(g: float, h: float, rules: FitRules) -> float:
    return rules.rate * g / (h + rules.ridge)


def _grow(g: np.ndarray, h: np.ndarray, n: np.ndarray, rules: FitRules) -> np.ndarray:
    """A tree over the ordered bins of one feature, as an entry per bin: the best split first, up to ``leaves``."""
    cg, ch, cn = (np.r_[0, np.cumsum(v)] for v in (g, h, n))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + rules.ridge)

    def best(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        at = at[(cn[at] - cn[a] >= rules.min_rows) & (cn[b] - cn[at] >= rules.min_rows)]
        if not len(at):
            return 0.0, -1
        won = gain(a, at) + gain(at, b) - gain(a, b)
        k = int(won.argmax())
        return float(won[k]), int(at[k])

    leaves = [(0, len(g), *best(0, len(g)))]
    while len(leaves) < rules.leaves:
        k = max(range(len(leaves)), key=lambda i: leaves[i][2])
        a, b, won, at = leaves[k]
        if at < 0 or won <= 1e-9:
            break
        leaves[k:k + 1] = [(a, at, *best(a, at)), (at, b, *best(at, b))]
    out = np.zeros(len(g))
    if len(leaves) > 1:
        for a, b, _, _ in leaves:
            out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a], rules)
    return out


def _grow_pair(g: np.ndarray, h: np.ndarray, n: np.ndarray, rules: FitRules) -> tuple[np.ndarray, float]:
    """The best four quadrants of two features' bins, and what they gain."""
    sums = [np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h, n)]
    r, c = g.shape
    a, b = np.arange(1, r)[:, None], np.arange(1, c)[None, :]
    gain, small = 0.0, np.zeros((r - 1, c - 1), bool)
    for rows in ((0, a), (a, r)):
        for cols in ((0, b), (b, c)):
            sg, sh, sn = (s[rows[1], cols[1]] - s[rows[0], cols[1]] - s[rows[1], cols[0]] + s[rows[0], cols[0]] for s in sums)
            gain = gain + sg ** 2 / (sh + rules.ridge)
            small |= sn < rules.min_rows
    gain = np.where(small, 0.0, gain)
    if not gain.size or gain.max() <= 1e-9:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, r)):
        for cols in (slice(0, j + 1), slice(j + 1, c)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum(), rules)
    return out, float(gain[i, j])


def fit_gam(x: np.ndarray, y: np.ndarray, rules: FitRules = FitRules()) -> Gam:
    """The model of labels ``y`` (0 or 1) by features ``x``. Without rows it scores 0.5, with one label its smoothed share."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    model = Gam(float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    held = np.arange(n) % rules.held_share == rules.held_share - 1 if n >= 20 * rules.held_share else np.zeros(n, bool)
    model.edges = [_cuts(x[:, f], rules.bins) for f in range(x.shape[1])]
    model.coarse = [_cuts(x[:, f], rules.pair_bins) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(cut) + 1) for cut in model.edges]
    fine = [np.searchsorted(cut, x[:, f], "right") for f, cut in enumerate(model.edges)]
    rough = [np.searchsorted(cut, x[:, f], "right") for f, cut in enumerate(model.coarse)]
    margin = np.full(n, model.base)
    learn = ~held

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return np.where(learn, y - p, 0.0), np.where(learn, p * (1 - p), 0.0)

    def loss() -> float:
        at = held if held.any() else learn
        return float(np.logaddexp(0, np.where(y[at] > 0, -margin[at], margin[at])).mean())

    def boost(cells: list[np.ndarray], tables: list[np.ndarray], grow) -> None:
        """Cycles over the tables; what the held rows didn't gain from in the end is taken back."""
        nonlocal margin
        best, kept, waited = loss(), [t.copy() for t in tables], 0
        kept_margin = margin.copy()
        for _ in range(rules.rounds):
            for cell, table in zip(cells, tables):
                g, h = residual()
                size = table.size
                step = grow(*(np.bincount(cell, weights=v, minlength=size).reshape(table.shape) for v in (g, h, learn)))
                table += step
                margin += step.ravel()[cell]
            now = loss()
            if now < best - 1e-6:
                best, kept, kept_margin, waited = now, [t.copy() for t in tables], margin.copy(), 0
            else:
                waited += 1
                if waited == 10:
                    break
        for table, t in zip(tables, kept):
            table[...] = t
        margin = kept_margin

    boost(fine, model.tables, lambda g, h, k: _grow(g, h, k, rules))
    # the pairs with the largest gain of one tree on what is left
    g, h = residual()
    gains = []
    for a, b in combinations(range(x.shape[1]), 2):
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        cell = rough[a] * shape[1] + rough[b]
        _, gain = _grow_pair(*(np.bincount(cell, weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (g, h, learn)), rules)
        gains.append((gain, -a, -b))
    chosen = [(-a, -b) for gain, a, b in sorted(gains, reverse=True)[:rules.pairs] if gain > 0]
    tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in chosen]
    boost([rough[a] * (len(model.coarse[b]) + 1) + rough[b] for a, b in chosen], tables, lambda g, h, k: _grow_pair(g, h, k, rules)[0])
    model.pairs = [(a, b, t) for (a, b), t in zip(chosen, tables)]
    return model


def held_out(id_: Column) -> Column:
    """True for the fifth of the documents that is never learned from; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _features(batches: Iterator[pa.RecordBatch], carried: int) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """The first ``carried`` columns of a batch and the features of the texts, which are its last column."""
    for b in batches:
        for lo, hi, texts in chunks(b.column(b.num_columns - 1)):
            yield [b.column(i).slice(lo, hi - lo) for i in range(carried)], text_features(texts)


def learn_quality(
        docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rules: FitRules = FitRules()) -> Gam:
    """The model learned from ``rules.max_rows`` labelled rows at most.

    Rows of ``labels`` without id or label, held-out ids and labels other than 0 and 1 are left out. The sample is the
    rows with the smallest hashes of id and label, so it doesn't depend on partitions. Only their texts are read by
    Python, and only their features (a few numbers a row) reach the driver.
    """
    ship_package(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("__id", F.lit(5)), "__id", "y").limit(rules.max_rows)
    texts = docs.select(F.col(id_col).alias("__id"), text_col).join(F.broadcast(sample), "__id").select("__id", "y", text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, y), x in _features(batches, 2):
            off = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, y, pa.ListArray.from_arrays(off, pa.array(x.ravel()))], ["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = texts.mapInArrow(measure, f"id {kind}, y double, x array<double>")
    # an id that repeats in docs may give more rows than the bound: it holds for the rows fitted, too
    found = found.orderBy(F.xxhash64("id", F.lit(5)), "id", "y", "x").limit(rules.max_rows).select("y", "x").toArrow()
    x = np.array(found.column("x").combine_chunks().flatten() if len(found) else [], np.float64).reshape(-1, len(FEATURES))
    return fit_gam(x, np.array(found.column("y"), np.float64), rules)


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` per row of ``docs``: bins looked up for a chunk of texts at once."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), x in _features(batches, 1):
            score = model.score(x).round(9)
            yield pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def classify_quality(
        docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        rules: FitRules = FitRules()) -> DataFrame:
    """Learns from the labelled rows that are not held out, scores all: ``doc_id, held_out, score, predicted``.

    One row per row of ``docs``. Null text counts as empty; a text without a word has the features 0 and the score of
    such texts. Null ids pass through (held out), rows that repeat an id are scored one by one and all learned from.
    Without labels every score is 0.5; labels of one kind give the same score to all. Ties in the sample's order are of
    equal rows. Other columns are not read. A very long text costs memory in proportion to its length (about 60 bytes a
    byte for the arrays over its words) and time in proportion, too.
    """
    model = learn_quality(docs, labels, label_col, id_col, text_col, rules)
    scored = score_quality(docs, model, id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
