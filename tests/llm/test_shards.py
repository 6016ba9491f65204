"""The shard files of op8: every row once, in the place it was given."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

from almanaq.llm import hilbert


@pytest.mark.parametrize("name", ["odd_docs", "edge_docs"])
def test_shard_files_have_every_row_once(name, request, spark, tmp_path):
    docs = request.getfixturevalue(name)
    placed = hilbert.hilbert_shards(docs)
    hilbert.write_shards(docs, placed, str(tmp_path / "shards"))
    files = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(tuple(r) for r in files.select(*docs.columns).collect()) == Counter(tuple(r) for r in docs.collect())
    place = ["doc_id", "shard", "slot", "curve"]
    assert Counter(tuple(r) for r in files.select(*place).collect()) == Counter(tuple(r) for r in placed.select(*place).collect())


def test_filters_skip_files(spark, tmp_path):
    """Files whose bounds admit a filter, against files of arbitrary order. Source skips little: the grid takes sources by
    hash, so a file's few sources may lie far apart in name order."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hilbert.write_shards(docs, hilbert.hilbert_shards(docs, 32), str(tmp_path / "curve"))
    docs.repartition(32).write.parquet(str(tmp_path / "any"))

    def read(folder, column, value):
        files = list((tmp_path / folder).rglob("*.parquet"))
        hit = 0
        for f in files:
            meta = pq.ParquetFile(f).metadata
            at = meta.schema.names.index(column)
            bounds = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
            hit += any(b.has_min_max and b.min <= value <= b.max for b in bounds)
        return hit / len(files)

    for column, most in (("lang", 0.7), ("source", 0.85)):
        values = [r[0] for r in docs.where(f"{column} is not null").select(column).distinct().collect()]
        share = {folder: sum(read(folder, column, v) for v in values) / len(values) for folder in ("curve", "any")}
        print(column, share)
        assert share["curve"] < most * share["any"], (column, share)
