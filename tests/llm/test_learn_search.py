"""Quality classifier, collocations and lexical search against plain versions, on odd texts and the driver's tables."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from almanaq.llm import collocations, gam, lexical_search, wordgrid

from . import brute

SF = "/root/testdata/sf0.01"


def plain_features(text):
    words = brute.WORD.findall(text or "")
    if not words:
        return [0.0] * len(gam.FEATURES)
    raw = [w.encode() for w in words]
    solid, n = b"".join(raw), len(words)
    has = lambda chars: sum(solid.count(c.encode()) for c in chars)
    marks = sum(b < 128 and not chr(b).isalnum() and chr(b) not in ".!?,;:\"'()-|" for b in solid)
    lines = [tuple(brute.WORD.findall(x)) for x in (text or "").split("\n") if brute.WORD.search(x)]
    windows = [tuple(words[p:p + 5]) for p in range(n - 4)]
    covered = {p + j for p, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    upper = lambda b: sum(65 <= x <= 90 for x in b)
    return [
        math.log1p(n), len(solid) / n, math.log1p(max(map(len, raw))), upper(solid) / len(solid), has("0123456789") / len(solid), marks / len(solid),
        has("|") / len(solid), has("!?") / len(solid), has(".!?") / n, has(",;:") / n, len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, len(covered) / n, (len(lines) - len(set(lines))) / len(lines), math.log1p(n / len(lines)),
        sum(x[-1][-1] in ".!?" for x in lines) / len(lines), sum(2 * upper(b) > len(b) for b in raw) / n, sum(len(b) == 1 for b in raw) / n]


def test_features(edge_rows):
    texts = [t for _, t in edge_rows if len(t or "") < 5000] + ["A b!\nA b!\n\nc| d?", "x " * 9 + "\nx\tx", "é É"]
    found = np.concatenate([gam.text_features(part) for _, _, part in wordgrid.chunks(pa.array(texts, pa.string()))])
    assert np.allclose(found, [plain_features(t) for t in texts], rtol=1e-12, atol=1e-12)


def test_trees_find_the_best_split():
    rng = np.random.default_rng(1)
    rules = gam.FitRules(leaves=2, min_rows=3)
    for _ in range(50):
        g, h, n = rng.normal(size=9), rng.random(9), rng.integers(0, 4, 9)
        gains = {c: g[:c].sum() ** 2 / (h[:c].sum() + 1) + g[c:].sum() ** 2 / (h[c:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
                 for c in range(1, 9) if n[:c].sum() >= 3 and n[c:].sum() >= 3}
        tree = gam._grow(g, h, n, rules)
        if gains and max(gains.values()) > 1e-9:
            cut = max(gains, key=gains.get)
            assert np.flatnonzero(np.diff(tree)).tolist() == [cut - 1] and tree[0] == pytest.approx(0.1 * g[:cut].sum() / (h[:cut].sum() + 1))
        else:
            assert not tree.any()


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    y = ((x[:, 1] > 0.5) != (x[:, 3] > 0.5)).astype(float)
    model = gam.fit_gam(x, y)
    assert (1, 3) in [(a, b) for a, b, _ in model.pairs] and ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    for row in x[:20]:  # a score is a sum of look-ups
        total = model.base + sum(t[sum(row[f] >= c for c in cut)] for f, (cut, t) in enumerate(zip(model.edges, model.tables)))
        total += sum(t[sum(row[a] >= c for c in model.coarse[a]), sum(row[b] >= c for c in model.coarse[b])] for a, b, t in model.pairs)
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-total)))


def test_op11_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = {r["doc_id"]: r for r in gam.classify_quality(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in found.items())
    held = [(found[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in found and found[r["doc_id"]]["held_out"]]
    assert sum(r["predicted"] == q for r, q in held) >= 0.95 * len(held)
    good, bad = [r["score"] for r, q in held if q == 1], [r["score"] for r, q in held if q == 0]
    assert sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(good, bad)) >= 0.97 * len(good) * len(bad)
    again = {r["doc_id"]: r["score"] for r in gam.classify_quality(docs.repartition(7), labels.repartition(3)).collect()}
    assert again == {i: r["score"] for i, r in found.items()}


def test_op11_odd_labels(spark, odd_docs, no_docs):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, y int, lang string")
    scores = lambda found: sorted({(r["score"], r["predicted"]) for r in found.collect()})
    assert scores(gam.classify_quality(odd_docs, labels([]))) == [(0.5, 1)]
    assert gam.classify_quality(no_docs, labels([(7, 1, None, None)])).collect() == []
    one = gam.classify_quality(odd_docs, labels([(7, 1, None, None), (7, 1, None, None), (8, None, 5, "x"), (9, 3, 0, None), (None, 0, 0, None)]))
    assert scores(one) == [(round(5 / 6, 9), 1)] and one.count() == 7  # two rows of id 7, two labels each
    both = gam.classify_quality(odd_docs, labels([(7, 1, None, None), (8, 0, 5, "x")]), rules=gam.FitRules(max_rows=3)).collect()
    assert len(both) == 7 and all(0 <= r["score"] <= 1 for r in both)


def test_op12(spark, edge_docs, edge_rows):
    langs = ["en", "de", None]
    rows = [(t, langs[i % 3]) for i, t in edge_rows]
    for least, sample in ((2, 8), (3, 1), (2, 10_000)):  # the last sample is empty: every level is a failure
        found = collocations.collocations(edge_docs, least=least, top=500, sample_of=sample)
        assert sorted(tuple(r) for r in found.collect()) == brute.op12(rows, least, 500)


def test_op12_pieces_and_ties(spark):
    rows = [("a b. a b! a\tb  c\x0bA B", "x")] * 3 + [("a b", "y")] * 5 + [("b\x1ca é É\x00 a b", None), (None, "x"), ("", "x"), (" .\t", "z")] + [("w " * 50, "q")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    found = collocations.collocations(docs, least=2)
    assert sorted(tuple(r) for r in found.collect()) == brute.op12(rows, 2)


def test_op12_rows(spark, no_docs, odd_docs):
    assert collocations.collocations(no_docs, least=1).collect() == []
    rows = [(r["text"], r["lang"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in collocations.collocations(odd_docs, least=2).collect()) == brute.op12(rows, 2)


def test_op12_weak_hash(monkeypatch, edge_rows):
    monkeypatch.setattr(collocations, "hash_spans", lambda view, start, length: (length % 3).astype(np.uint64))
    rows = [(t, "abc"[i % 3]) for i, t in edge_rows if len(t or "") < 5000]
    c = collocations.Corpus([x for _, x in rows], wordgrid.strings(pa.array([t for t, _ in rows])))
    number = c.number()[0]
    words = [(c.names[lang], c.view.base[a:a + n].tobytes()) for lang, a, n in zip(c.lang, c.start, c.length)]
    assert len(set(number.tolist())) == len(set(words)) == len(set(zip(number.tolist(), words)))


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def ranked(found):
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_op13(spark, edge_docs, edge_rows):
    rng = random.Random(3)
    items = [t for _, t in edge_rows if rng.random() < 0.3] + [None, "", "!", "no-such-word", "a A a", "Licensed under the Apache"]
    found = ranked(lexical_search.lexical_search(edge_docs, items_of(spark, items)))
    assert found == brute.op13(edge_rows, list(enumerate(items)))
    assert found == ranked(lexical_search.lexical_search(edge_docs.repartition(3), items_of(spark, items), block_bytes=2000))


def test_op13_driver_table(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.op13([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert ranked(lexical_search.lexical_search(docs, items)) == want


def test_op13_ties_and_odd_ids(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, "same words here") for i in random.Random(1).sample(range(100), 60)] + [(None, "same words here"), (500, "same")], "doc_id long, text string")
    items = items_of(spark, ["same words", "same words", "here"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ranked(lexical_search.lexical_search(docs, items)) == brute.op13(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert ranked(lexical_search.lexical_search(odd_docs, items_of(spark, ["two words one", None]))) == brute.op13(rows, [(0, "two words one")])
    assert lexical_search.lexical_search(no_docs, items).collect() == [] and lexical_search.lexical_search(docs, items_of(spark, []).limit(0)).collect() == []


def test_segment_search_against_all_scores():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, terms = int(rng.integers(1, 60)), 6
        grid = np.where(rng.random((n, terms)) < 0.4, rng.integers(1, 5, (n, terms)), 0)
        doc, term = np.nonzero(grid)
        ids = np.sort(rng.integers(0, 80, n))
        segment = lexical_search.Segment(n, terms, doc, term, grid[doc, term])
        for k in (1, 3, 100):
            asked = np.flatnonzero(rng.random(terms) < 0.7)
            score = grid[:, asked].sum(1)
            want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if s > 0)[:k]
            found = segment.search(asked, k, None, ids)
            assert sorted((-s, int(ids[d])) for s, d in found) == want
            if len(want) > 2:  # with a floor only what comes before it is promised
                floor = -want[1][0], want[1][1]
                found = sorted((-s, int(ids[d])) for s, d in segment.search(asked, k, floor, ids))
                assert found[:1] == want[:1]


def test_search_visits_few_documents(monkeypatch):
    """Bounds end the search: of 100,000 documents a few are scored."""
    n = 100_000
    rng = np.random.default_rng(5)
    impact = rng.integers(1, 100, n)
    impact[rng.choice(n, 10, False)] = 1000
    segment = lexical_search.Segment(n, 1, np.arange(n), np.zeros(n, np.int64), impact)
    calls = []
    top = segment.top
    monkeypatch.setattr(segment, "top", lambda a, b: calls.append(a.size) or top(a, b))
    found = segment.search(np.array([0]), 10, None, np.arange(n))
    assert [s for s, _ in found] == [1000] * 10 and sum(calls) < 2000


def test_term_pattern():
    text = "a-b_c9É\x7fŹ ¡x"
    t = lexical_search.Terms(wordgrid.strings(pa.array([text, None, "q"])))
    words = [t.view.base[a:a + n].tobytes().decode() for a, n in zip(t.start, t.length)]
    assert words == [*re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower_az(text)), "q"] and t.n.tolist() == [len(words) - 1, 0, 1]
