import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, words string, seed long, size long"


def edge_texts():
    """Odd texts: null, empty, white space, ties, long ones, scripts, marks, passages and copies with small changes."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeßéñ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, long = text(60), text(9000)
    texts = [None, "", " ", "\n\t\n", "a", "A", "a a a a a a a a a a a a a a a a a a a a a a a a a a", "日本語 テスト です", "12345 67", "'s it's 'LL", "😀 👍🏽 !!!",
             passage, passage.replace(" ", "\n"), passage.upper(), f"x {passage} y {passage}", long, long + " end", long.replace(" ", "  "),
             "Licensed under the Apache License, Version 2.0. Under the MIT License! cc-by-nc 4.0, CC BY NC under the mit license",
             "a<|endoftext|> b <|startoftext|>c", "K Kelvin under the mit license", "\x00\x01 nul \x1c x\x85y z", "line\nline\nline\nother line\nline"]
    for _ in range(60):
        t = text(rng.randint(5, 80)).split()
        texts.append(" ".join(t))
        for _ in range(rng.randint(0, 3)):
            u = list(t)
            for _ in range(rng.randint(0, 4)):
                u[rng.randrange(len(u))] = rng.choice(vocab)
            texts.append(" ".join([*u, *([passage] if rng.random() < 0.2 else [])]))
    return texts


@pytest.fixture(scope="session")
def edge_rows():
    rows = list(enumerate(edge_texts()))
    random.Random(1).shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """With extra columns whose names the operators use inside, all null."""
    langs = ["en", "de", None]
    return spark.createDataFrame(
        [(i, t, langs[i % 3], None if i % 5 else "s", None, None, None, None, None) for i, t in edge_rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, rows that repeat, and an id with several texts."""
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    return spark.createDataFrame([
        (None, same, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None),
        (7, same, "en", "s", 1, None, None, None, None), (7, same, "en", "s", 1, None, None, None, None),
        (9, same, "en", "s", 1, None, None, None, None), (8, "left text", "en", None, 1, None, None, None, None), (8, same, None, "s", 1, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
