"""License scans by diagonal voting: word k-grams of documents joined to template positions.

A hit of template gram ``t`` at word ``p`` votes for the diagonal ``p - t``. Votes are summed per diagonal, neighbouring
diagonals (words inserted or left out) are merged, and a span counts when enough of the template's grams were seen.
Everything is DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3

#: Phrases that are found word by word, and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Public notices that are found by votes, and their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
)

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = -1  # pseudo template: one row per document, at the position after its last word


def license_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased. ``lower`` alone would also turn the Kelvin sign into a plain k."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(low, _SEPARATORS), "")


def _template_grams(spark, base, templates) -> tuple[DataFrame, DataFrame]:
    grams, info = [], [(_END, "", False, 1)]
    for i, (label, text) in enumerate([*base, *templates]):
        words = [w for w in re.split(_SEPARATORS, text) if w]
        if len(words) < K:
            raise ValueError(f"a phrase needs {K} words: {text}")
        info.append((i, label, i < len(base), len(words) - K + 1))
        grams += [(i, t, *words[t:t + K]) for t in range(len(words) - K + 1)]
    cols = [f"t{j}" for j in range(K)]
    rows = spark.createDataFrame(grams, f"template int, tpos int, {', '.join(c + ' string' for c in cols)}")
    rows = rows.withColumn("gram", F.xxhash64(*cols))
    end = spark.range(1).select(F.lit(_END).alias("template"), F.lit(0).alias("tpos"), *[F.lit("").alias(c) for c in cols], _end_gram().alias("gram"))
    return rows.unionByName(end), spark.createDataFrame(info, "template int, label string, is_base boolean, n_grams int")


def _end_gram() -> Column:
    return F.xxhash64(F.lit(" end of document "))


def license_spans(
        docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES,
        max_shift: int = 3, min_coverage: float = 0.6) -> DataFrame:
    """One row per found span, ``uid, doc_id, n_words, label, is_base, first_word, last_word, coverage``, and one without
    a label per row of ``docs``. ``uid`` tells rows apart, so rows that repeat an id are scanned one by one."""
    spark = docs.sparkSession
    grams, info = _template_grams(spark, base, templates)

    def scan(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, K)]))
        return F.struct(w.alias("words"), F.array_append(hashes, _end_gram()).alias("grams"))

    # the lambda binds the words once; a plain column would be split again for every word
    scanned = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
        F.transform(F.array(license_words(F.col(text_col))), scan)[0].alias("s"))
    rolled = scanned.select("uid", "doc_id", F.col("s.words").alias("words"), F.posexplode("s.grams").alias("pos", "gram"))
    same = [F.get("words", F.col("pos") + j) == F.col(f"t{j}") for j in range(K)]
    verified = (F.col("template") == _END) | (same[0] & same[1] & same[2])
    hits = (
        rolled.join(F.broadcast(grams), "gram").where(verified)
        .select("uid", "doc_id", "template", "tpos", "pos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .repartition("uid"))
    votes = hits.groupBy("uid", "doc_id", "template", "diagonal").agg(
        F.collect_set("tpos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    votes = votes.join(F.broadcast(info), "template")
    by_diagonal = Window.partitionBy("uid", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    votes = votes.withColumn("opens", F.when(F.col("is_base") | gap.isNull() | (gap > max_shift), 1).otherwise(0))
    votes = votes.withColumn("run", F.sum("opens").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    runs = votes.groupBy("uid", "doc_id", "template", "label", "is_base", "n_grams", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("first").alias("first"), F.max("last").alias("last"))
    coverage = F.size("seen") / F.col("n_grams")
    return runs.withColumn("coverage", coverage).where(
        F.when(F.col("is_base"), F.col("coverage") == 1).otherwise(F.col("coverage") >= min_coverage)).select(
        "uid", "doc_id", F.when(F.col("template") == _END, F.col("first")).cast("long").alias("n_words"),
        F.when(F.col("template") != _END, F.col("label")).alias("label"), "is_base",
        F.col("first").cast("long").alias("first_word"), (F.col("last") + K - 1).cast("long").alias("last_word"), "coverage")


def license_labels(docs: DataFrame, **parameters) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base phrase. ``score`` is the largest
    coverage of a template (1 with a base phrase, 0 without any span). Null and empty texts have no words; a null id
    passes through; other columns are not read.
    """
    spans = license_spans(docs, **parameters)
    found, base = F.col("label").isNotNull(), F.col("label").isNotNull() & F.col("is_base")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("uid", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"), F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("coverage"))), F.lit(0.0)).alias("score")).drop("uid")
