"""A corpus in five stages: language ID, exact dedup, near dedup, mixing, BPE.

Every stage takes the documents its predecessor kept and returns the rows that stay, with the columns of documents; the
last one encodes and decodes them. Between stages the rows are written as Parquet and read again, so each stage starts
from files and a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from almanaq.llm.common import documents, materialise
from almanaq.llm.exact_dedup import drop_duplicates
from almanaq.llm.language_id import keep_identified
from almanaq.llm.mixing import sample_mix
from almanaq.llm.near_dedup import keep_one_of_each
from almanaq.llm.queries import bpe_digests


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters go, and some far from every language."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a similarity of 0.8 on shingles of five words."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target mix of sources, languages and topics."""
    return sample_mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe_digests(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: Hyperdimensional vectors and merges of a vocabulary have no SQL form; tests/llm/test_pipeline.py compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
