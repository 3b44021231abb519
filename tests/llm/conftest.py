import zlib

import pytest


@pytest.fixture
def docs(spark):
    """Documents with nulls, empty, blank, short, long, repeated and equal texts, and clashing columns."""
    long = " ".join(f"word{i % 997} and{i % 31}" for i in range(30_000))
    near = " ".join(f"w{i}" for i in range(100))
    rows = [
        (0, "the quick brown fox jumps over the lazy dog and then it runs away from the big bear", "en"),
        (1, None, "en"), (2, "", None), (3, " \t\n ", "en"), (4, "a", "en"), (5, long, "en"),
        (6, near, "en"), (7, near, "en"), (7, near, "en"), (8, near.replace("w50", "x50"), "en"), (9, "### *** $$$ %%% <<>> |||", None),
        (None, "a row without an id but with some words in it", None), (10, "line one is here\nline one is here\nother\n\n\n", "en"),
        (11, "ein kurzer satz mit wörtern für die sprache ß und ü", "de"), (12, "<|endoftext|> inside\x1ctext\u00a0here\u2003x  y", "en"), (13, "IDIOT!!! 🙂🙂 e\u0301 \u1e9b\u0323 don't we'll", "en"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_words int, score string, bands string, features int"
    return spark.createDataFrame([(*r, "s", -1, "clash", "clash", 7) for r in rows], schema)


@pytest.fixture
def nothing(docs):
    return docs.limit(0)


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
