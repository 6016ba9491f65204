"""Near dedup with shingles of five words, the pipeline's."""

import corpus_pipeline
from almanaq.llm import near_dedup

from . import brute
from .test_operators import table


def test_near_dedup_of_five_words(spark, edge_docs, edge_rows):
    found = table(near_dedup.near_duplicates(edge_docs, words=5), "n_shingles", "component_id", "kept")
    assert found == brute.op7(edge_rows, width=5)
    # two words of fifty changed: 45 of 53 two-word shingles are shared, 36 of 56 of five words
    text = [f"w{i}" for i in range(50)]
    changed = ["x" if i in (15, 35) else w for i, w in enumerate(text)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(changed)), (3, " ".join(text[:49]))], "doc_id long, text string")
    assert {r["doc_id"] for r in near_dedup.near_duplicates(docs).where("kept").collect()} == {1}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 2}
