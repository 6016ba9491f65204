"""Every operator against its plain version, on odd texts and on the driver's small table."""

import math
import random
import subprocess
import sys
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from almanaq.llm import bpe, exact_dedup, hilbert, language_id, license_scan, mixing, near_dedup, quality, queries, substring_dedup, token_files

from . import brute

SF = "/root/testdata/sf0.001"


def table(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module", params=["edge", "driver"])
def corpus(request, spark, edge_docs, edge_rows):
    if request.param == "edge":
        return edge_docs, edge_rows
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_op1(corpus):
    docs, rows = corpus
    found = substring_dedup.substring_dedup(docs).withColumn("sha", F.sha2("clean_text", 256))
    assert table(found, "n_words", "n_removed", "sha") == brute.op1(rows)


def test_op1_common_seeds_and_short_passages(edge_docs, edge_rows):
    found = substring_dedup.substring_dedup(edge_docs, common=2, piece=3).withColumn("sha", F.sha2("clean_text", 256))
    assert table(found, "n_words", "n_removed", "sha") == brute.op1(edge_rows)


def test_op1_one_word_texts_of_100000_words(spark):
    rows = [(i, " ".join(["w"] * (100_000 + i % 2) + [f"end{i // 3}"])) for i in range(6)] + [(9, "w " * 12), (10, "w " * 13), (11, "v " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for common in (4096, 1):
        found = substring_dedup.substring_dedup(docs, common=common).withColumn("sha", F.sha2("clean_text", 256))
        assert table(found, "n_words", "n_removed", "sha") == brute.op1(rows)


def test_copies_of_common_passages_are_one(spark):
    """300 copies of a passage and one that holds its end: windows of two passages, not of 301."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, 3, " ".join(words)) for i in range(1, 301)] + [(0, 5, " ".join(["x", *words[20:]]))]
    passages = spark.createDataFrame(rows, "id long, at int, words string").repartition(7).withColumn("passage", F.unhex(F.sha2("words", 256)))
    assert substring_dedup.distinct_windows(passages, 13).count() == 28 + 9
    found = {r["id"]: sorted(r["starts"]) for r in substring_dedup.repeated_in_common(passages, 13).collect()}
    assert found == {1: list(range(23, 31)), **{i: list(range(3, 31)) for i in range(2, 301)}}


def test_op1_full_bit_maps(edge_docs, edge_rows, monkeypatch):
    """As at a scale where every bit is set."""
    real = substring_dedup._seeds_of_several
    monkeypatch.setattr(substring_dedup, "_seeds_of_several", lambda runs, common: (real(runs, common)[0] | ~substring_dedup.U(0), real(runs, common)[1]))
    found = substring_dedup.substring_dedup(edge_docs).withColumn("sha", F.sha2("clean_text", 256))
    assert table(found, "n_words", "n_removed", "sha") == brute.op1(edge_rows)


def test_automaton_against_all_windows():
    rng = random.Random(3)
    for _ in range(200):
        docs = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(6)]
        first = {}
        for i, d in enumerate(docs):
            for p in range(len(d) - 3):
                first.setdefault(tuple(d[p:p + 4]), i)
        assert substring_dedup.first_owners(list(enumerate(docs)), 4) == [[first[tuple(d[p:p + 4])] for p in range(len(d) - 3)] for d in docs]


def test_op2(corpus):
    docs, rows = corpus
    assert table(exact_dedup.exact_duplicates(docs), "keep_id", "group_size", "kept", "text_sha256") == brute.op2(rows)


def test_op2_filters_merge_without_loss():
    import numpy as np

    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 64, 500, dtype=np.uint64) >> np.uint64(s) for s in (0, 0, 50, 50)]
    by_range = {}
    for p in parts:
        for f in exact_dedup.build_filter(p, 6):
            by_range.setdefault(f[0], []).append(f)
    merged = [exact_dedup.merge_filters(fs, 6) for _, fs in sorted(by_range.items())]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert np.array_equal(np.concatenate([v for v, _ in merged]), values)
    assert np.array_equal(np.concatenate([c for _, c in merged]), counts)


def test_op3_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.mix_weights(docs)
    rows = found.collect()
    assert len(rows) == 1000 and {r["kept"] for r in rows} == {True, False}
    for d, power in mixing.TEMPER.items():
        tokens, mixed = {}, {}
        for r in rows:
            tokens[r[d]] = tokens.get(r[d], 0) + r["n_tokens"]
            mixed[r[d]] = mixed.get(r[d], 0) + r["n_tokens"] * r["probability"]
        raised = {k: v ** power for k, v in tokens.items()}
        for k in tokens:
            assert abs(mixed[k] / sum(mixed.values()) - raised[k] / sum(raised.values())) < 1e-3
    again = table(mixing.mix_weights(docs.repartition(7)), "probability", "kept")
    assert again == {r["doc_id"]: (r["probability"], r["kept"]) for r in rows}


def one_language_sources(spark):
    """20 sources of one language each, the first one with most of the tokens, and two topics."""
    rows = [(f"s{s}", "abcd"[s % 4], "w " * (30 + 7 * s) + end) for s in range(20) for end in ("x", "1") for _ in range(40 if s == 0 else 1 + s % 3)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, text string").repartition(4)


def mixed_shares(rows, d):
    mixed = {}
    for r in rows:
        mixed[r[d]] = mixed.get(r[d], 0) + r["n_tokens"] * r["probability"]
    return {k: v / sum(mixed.values()) for k, v in mixed.items()}


def test_op3_one_language_sources(spark):
    docs = one_language_sources(spark)
    rows = mixing.mix_weights(docs).collect()
    assert len(rows) == docs.count() and {r["targets"] for r in rows} == {"joint"}
    tokens = {d: {} for d in mixing.TEMPER}
    for r in rows:
        for d in tokens:
            tokens[d][r[d]] = tokens[d].get(r[d], 0) + r["n_tokens"]
    weight = [r["n_tokens"] * math.prod(tokens[d][r[d]] ** (p - 1) for d, p in mixing.TEMPER.items()) for r in rows]
    for d in tokens:
        for k, share in mixed_shares(rows, d).items():
            want = sum(w for r, w in zip(rows, weight) if r[d] == k) / sum(weight)
            assert abs(share - want) < 1e-5 * want


def test_op3_slow_tables_reach_their_targets(spark):
    """Every cell is there, so the tempered marginals exist; some cells are tiny, so raking takes many rounds."""
    rows = [(f"s{s}", lang, "w " * (4 if s == i else 1)) for s in range(4) for i, lang in enumerate("abcd") for _ in range(1 + 40 * (s == 0) * (i == 0))]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, text string").repartition(2)
    found = mixing.mix_weights(docs).collect()
    assert {r["targets"] for r in found} == {"tempered"}
    for d in ("source", "lang"):
        tokens = {}
        for r in found:
            tokens[r[d]] = tokens.get(r[d], 0) + r["n_tokens"]
        raised = {k: v ** mixing.TEMPER[d] for k, v in tokens.items()}
        assert mixed_shares(found, d) == pytest.approx({k: v / sum(raised.values()) for k, v in raised.items()}, abs=1e-5)


def test_op3_given_targets(spark):
    docs = one_language_sources(spark)
    shares = lambda d, given: spark.createDataFrame(list(given.items()), f"{d} string, target double")
    langs = {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4}
    rows = mixing.mix_weights(docs, targets={"lang": shares("lang", langs), "topic": shares("topic", {"prose": 0.75, "figures": 0.25})}).collect()
    assert {r["targets"] for r in rows} == {"given"}
    assert mixed_shares(rows, "lang") == pytest.approx(langs, abs=1e-5) and mixed_shares(rows, "topic") == pytest.approx({"prose": 0.75, "figures": 0.25}, abs=1e-5)
    some = mixing.mix_weights(docs, targets={"lang": shares("lang", {"a": 0.5, "b": 0.5})}).collect()
    assert len(some) == len(rows) and all((r["probability"] == 0) == (r["lang"] in "cd") for r in some)
    sources = {f"s{s}": 0.05 for s in range(20)}  # a quarter for each language
    with pytest.raises(ArithmeticError, match="lang d: asked 0.400000|source s"):
        mixing.mix_weights(docs, targets={"lang": shares("lang", langs), "source": shares("source", sources)})
    with pytest.raises(ArithmeticError, match="lang e: asked 0.500000, reached 0.000000"):
        mixing.mix_weights(docs, targets={"lang": shares("lang", {"a": 0.5, "e": 0.5})})


def test_op4_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language_id.identify_languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in told)
    held = [r for r in told if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1 for r in told)


def test_op4_edges(edge_docs, edge_rows):
    told = table(language_id.identify_languages(edge_docs), "lang_pred", "score")
    for i, t in edge_rows:
        assert (told[i][0] == "und") == (not any(c.isalpha() for c in t or ""))


def test_op4_long_texts_are_added_up_in_parts(monkeypatch):
    rng = random.Random(6)
    many = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) if rng.random() < 0.9 else rng.choice(" İΣ,ß1") for _ in range(20_000))
    texts = [many, "", "12 3", "Δέκα Σοφοί ΣΑΣ", "eine Zeile Text " * 500]
    bundles, n = language_id.document_bundles(texts, 128)
    assert n.tolist() == [sum(map(str.isalpha, t.lower())) for t in texts] and (bundles == bundles.round()).all()
    monkeypatch.setattr(language_id, "CHUNK", 777)
    for i, t in enumerate(texts):
        alone, m = language_id.document_bundles([t], 128)
        assert (alone[0] == bundles[i]).all() and m[0] == n[i]
    total = np.zeros(128)
    for a, b, c in ("\0ab", "ab\0", "\0c\0"):
        total = total + np.roll(language_id.letter_vector(ord(a), 128), 2).astype(int) * np.roll(language_id.letter_vector(ord(b), 128), 1) * language_id.letter_vector(ord(c), 128)
    assert (language_id.document_bundles(["Ab-c"], 128)[0][0] == total).all()


def test_op4_a_million_different_trigrams_in_bounded_memory():
    """In a process of its own, whose peak is its own."""
    code = (
        "import random, resource; from almanaq.llm import language_id as L; L.document_bundles(['warm'], 1024)\n"
        "rng = random.Random(1); t = ''.join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(1_000_000))\n"
        "peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024\n"
        "before = peak(); L.document_bundles([t], 1024); print(peak() - before)")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True)
    assert float(done.stdout) < 400  # MB


def test_op5(corpus):
    from tokenizers import Tokenizer

    docs, rows = corpus
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False)))
    assert table(queries.bpe_digests(docs), "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op6(corpus):
    docs, rows = corpus
    found = license_scan.license_labels(docs)
    assert table(found, "n_words", "n_base", "first_word", "last_word", "base_labels") == brute.op6(rows, license_scan.BASE)
    for r in found.collect():
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op6_notices_with_changes(spark):
    label, notice = license_scan.TEMPLATES[0]
    words = notice.split()
    changed = " ".join([*words[:8], "very", *words[8:15], *words[16:]])
    far = " ".join(words[:6])
    docs = spark.createDataFrame([(1, notice.upper()), (2, f"x {changed} y"), (3, far)], "doc_id long, text string")
    found = table(license_scan.license_labels(docs), "labels", "score")
    assert found[1] == (label, 1.0) and found[2][0] == label and 0.6 <= found[2][1] < 1 and found[3] == ("", 0.0)


def test_op7(corpus):
    docs, rows = corpus
    assert table(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept") == brute.op7(rows)


def test_op7_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = [(500, " ".join(base))]
    for i in range(300):
        u = list(base)
        for p in rng.sample(range(80), 3):
            u[p] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(u)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept") == brute.op7(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(200)]
    found = {r["id"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in range(700):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert found == want


def test_op8(corpus):
    docs, rows = corpus
    found = hilbert.hilbert_shards(docs).collect()
    counts = [sorted(r["slot"] for r in found if r["shard"] == s) for s in range(8)]
    assert sum(map(len, counts)) == len(rows) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert all(c == list(range(len(c))) for c in counts)
    texts = dict(rows)
    for r in found:
        blob = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(blob) + 1 and r["text_crc32"] == zlib.crc32(blob) and r["law"] == "rows"
    ordered = [r["curve"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
    assert ordered == sorted(ordered)


def test_hilbert_curve_visits_neighbours(spark):
    cells = [(x, y, z) for x in range(16) for y in range(16) for z in range(16)]
    df = spark.createDataFrame(cells, "x int, y int, z int")
    rows = df.withColumn("h", hilbert.hilbert_index([F.col(c) for c in "xyz"])).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(4096))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(rows, rows[1:]))


def test_op9(corpus):
    from tokenizers import Tokenizer

    docs, rows = corpus
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert table(token_files.token_files(docs), "start", "n_tokens", "ids_crc32") == brute.op9(rows, t)


def test_op9_one_id_of_many_rows(spark):
    """Rows of one id are no single file, and the files follow one another without a gap."""
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(None if i % 3 else 5, f"text {i} of many") for i in range(4000)], "doc_id long, text string").repartition(4)
    folder = f"{token_files.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with more rows than one task should take
    try:
        files = token_files.write_tokens(docs, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 2
    found = sorted(token_files.read_tokens(files, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None] * 2666 + [5] * 1334
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sums = lambda keep: sorted(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*t.encode(f"text {i} of many").ids, 0])) for i in range(4000) if keep(i))
    assert sorted(r["ids_crc32"] for r in found if r["doc_id"] == 5) == sums(lambda i: i % 3 == 0)
    assert sorted(r["ids_crc32"] for r in found if r["doc_id"] is None) == sums(lambda i: i % 3)


def test_op9_failed_write_leaves_no_file(tmp_path):
    def blobs():
        yield b"12"
        raise ValueError("lost")

    system, root = token_files._open(str(tmp_path))
    with pytest.raises(ValueError):
        token_files._put(system, f"{root}/x.bin", blobs())
    assert list(tmp_path.iterdir()) == []


def test_op10(corpus):
    docs, rows = corpus
    found = quality.line_first_cleaning(docs)
    assert table(found, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == brute.op10(rows)
    assert table(found, "kept", "n_words_left", "clean_text") == brute.op10_kept(rows, quality.NAVIGATION, quality.BOILERPLATE)


def test_op10_line_rules():
    rules = quality.Rules()
    assert quality.line_fails("Home | Menu | Search", rules) == "navigation" and quality.line_fails("Read more »", rules) == "navigation"
    assert quality.line_fails("Copyright 2024. All Rights Reserved.", rules) == "boilerplate"
    assert quality.line_fails("### *** ||| $$$ a", rules) == "punctuation" and quality.line_fails("1234 5678 90 x", rules) == "punctuation"
    assert quality.line_fails("The ten best places to (click and …)", rules) == "cut off" and quality.line_fails('He said "and then..."', rules) == "cut off"
    assert quality.line_fails("An ordinary sentence... without a home.", rules) is None
    for line in ("မြန်မာနိုင်ငံသည် အရှေ့တောင်အာရှတွင် တည်ရှိသည်။", "བོད་ཡིག་ནི་བོད་པའི་ཡི་གེ་ཡིན།", "हिन्दी में लिखा हुआ एक वाक्य।", "ภาษาไทยที่นี่"):
        assert quality.line_fails(line, rules) is None


OPERATORS = [
    substring_dedup.substring_dedup, exact_dedup.exact_duplicates, mixing.mix_weights, language_id.identify_languages, bpe.encode_decode,
    license_scan.license_labels, near_dedup.near_duplicates, hilbert.hilbert_shards, token_files.token_files, quality.line_first_cleaning]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_no_rows(operator, no_docs):
    assert operator(no_docs).collect() == []


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_null_and_repeated_ids_keep_their_rows(operator, odd_docs):
    ids = sorted((r["doc_id"] for r in operator(odd_docs).collect()), key=lambda x: (x is not None, x or 0))
    assert ids == [None, None, 7, 7, 8, 8, 9]


def test_ids_that_repeat(odd_docs):
    removed = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.substring_dedup(odd_docs).collect()}
    assert removed == {(None, 14): 0, (None, 0): 0, (7, 14): 0, (9, 14): 14, (8, 14): 0, (8, 2): 0}
    near = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_dedup.near_duplicates(odd_docs).collect()}
    assert near == {(None, 13): None, (None, 0): None, (7, 13): 7, (9, 13): 7, (8, 13): 7, (8, 1): 8}
    exact = {(r["doc_id"], r["group_size"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(odd_docs).collect()}
    assert exact == {(None, 5, 7, False), (None, 1, None, True), (7, 5, 7, True), (9, 5, 7, False), (8, 5, 7, False), (8, 1, 8, True)}
    left = [(r["doc_id"], r["text"][:4] if r["text"] else None) for r in exact_dedup.drop_duplicates(odd_docs).collect()]
    assert sorted(left, key=str) == [(7, "one "), (8, "left"), (None, None)]
