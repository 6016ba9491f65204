"""The pipeline's stages against plain versions: the rows kept after each, the digests at the end."""

from collections import Counter, defaultdict

import pytest
import public_tokenizers

import corpus_pipeline
from almanaq.llm import language_id, mixing

from . import brute
from .test_operators import table

COLUMNS = ["doc_id", "text", "lang", "source"]


def language_stage(rows):
    told = brute.op4([r[:3] for r in rows], language_id.letter_vector)
    return [r for r, (lang, score) in zip(rows, told) if lang != "und" and score >= 0.05]


def exact_stage(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c for c in r[1] or "" if c not in " \t\n\x0b\x0c\r")].append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]


def near_stage(rows):
    kept = brute.op7([r[:2] for r in rows if r[0] is not None], width=5)
    return [r for r in rows if r[0] is None or kept[r[0]][2]]


def mixing_stage(rows):
    return [r for r, (_, kept) in zip(rows, brute.op3(rows, mixing.TEMPER)[0]) if kept]


PLAIN = {"language_id": language_stage, "exact_dedup": exact_stage, "near_dedup": near_stage, "mixing": mixing_stage}


@pytest.mark.parametrize("name", ["edge_docs", "odd_docs", "no_docs"])
def test_stages(name, request, spark):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    for stage, f in corpus_pipeline.STAGES[:-1]:
        docs = mixing.materialise(f(spark, docs, ""))
        rows = PLAIN[stage](rows)
        assert Counter(tuple(r) for r in docs.select(*COLUMNS).collect()) == Counter(rows), stage
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.bpe(spark, docs, "").collect()) == want


def test_op3_probabilities(edge_docs):
    rows = [tuple(r) for r in edge_docs.select(*COLUMNS).collect()]
    want, law = brute.op3(rows, mixing.TEMPER)
    found = table(mixing.mix_weights(edge_docs), "probability", "kept", "targets")
    assert {r[0]: (pytest.approx(p, abs=1e-5), kept, law) for r, (p, kept) in zip(rows, want)} == found


def test_op4_cosines(edge_docs):
    rows = [tuple(r) for r in edge_docs.select(*COLUMNS).collect()]
    found = table(language_id.identify_languages(edge_docs), "lang_pred", "score")
    for (i, *_), (_, score) in zip(rows, brute.op4([r[:3] for r in rows], language_id.letter_vector)):
        assert found[i][1] == pytest.approx(score, abs=1e-5)
