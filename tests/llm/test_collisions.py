"""No hash decides a result: texts of a family on which polynomial hashes collide, and hashes made to collide."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from almanaq.llm import bpe, near_dedup, pieces, quality, queries, token_files, wordgrid

from . import brute


def morse(n, flip=False):
    """The Thue-Morse word of n letters; it and its complement collide under every polynomial hash modulo 2**64."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.fixture(scope="module")
def colliding(spark):
    rows = []
    for n in (1024, 4096):
        x, y = morse(n), morse(n, True)
        rows += [f"{x} one", f"{y} one", x, y, f"{x} {y}", " ".join([x, "a", "b", "c", "d", y, "a", "b", "c", "d"] * 2), f"{x} a b c d {y} a b c d e f g"]
    rows = list(enumerate(rows))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("parts", [1, 5])
def test_operators_on_colliding_words(colliding, parts):
    rows, docs = colliding
    docs = docs.repartition(parts)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: brute.sha(" ".join(map(str, t.encode(x, add_special_tokens=False).ids))) for i, x in rows}
    assert {r["doc_id"]: r["ids_sha256"] for r in queries.bpe_digests(docs).collect()} == want
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = token_files.token_files(docs).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == brute.op9(rows, t)
    found = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute.op7(rows)
    found = quality.line_first_cleaning(docs).collect()
    assert {r["doc_id"]: (r["n_repeat_words"], r["base_failed"]) for r in found} == {i: x[4:] for i, x in brute.op10(rows).items()}


@pytest.fixture
def weak_hash(monkeypatch):
    weak = lambda view, start, length: (length % 3).astype(np.uint64)
    monkeypatch.setattr(wordgrid, "hash_spans", weak)
    monkeypatch.setattr(pieces, "hash_spans", weak)


def texts(seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["a", "b", "ab", "ba", "abc", "x" * 1500, "x" * 1499 + "y", "zz" * 40]) for _ in range(rng.randint(0, 40))) for _ in range(30)]


def test_words_under_a_weak_hash(weak_hash):
    for seed in range(5):
        rows = list(enumerate(texts(seed)))
        words = wordgrid.Words(wordgrid.strings(pa.array([t for _, t in rows])), lower=True)
        size = near_dedup.shingle_sets(words)[1]
        assert size.tolist() == [len(s) for s in brute.shingle_sets(rows).values()]
        assert quality.repeated_words(words, 5).tolist() == [x[4] for x in brute.op10(rows).values()]
        doc, value, head, n = near_dedup._shingles(words, 2)
        digests = near_dedup.set_digests(words, doc, head, n, value)
        sets = list(brute.shingle_sets(rows).values())
        assert all((digests[i] == digests[j]) == (sets[i] == sets[j]) for i in range(30) for j in range(30))


def test_piece_table_under_a_weak_hash(weak_hash):
    v = bpe.Vocabulary(bpe.default_path())
    table = pieces.PieceTable(lambda words: v.merge([w.encode() for w in words]), limit=5)
    t = Tokenizer.from_file(bpe.default_path())
    for seed in range(4):
        rows = texts(seed)
        ids, counts = pieces.encode_texts(rows, table, False, v.special, bpe.normalise)
        want = [t.encode(x, add_special_tokens=False).ids for x in rows]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_sets_of_texts_are_held_by_size():
    sets = near_dedup._Sets(2, limit=100)
    for i in range(50):
        assert sets(f"a{i} b c") == frozenset([(f"a{i}".encode(), b"b"), (b"b", b"c")])
        assert sum(map(len, sets.held)) <= 100
    assert sets("w " * 200) == frozenset([(b"w", b"w")]) and len(sets.held) == 1
