from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = "Word one, word two; the " * 3000

# nulls, empty and very long texts, repeated rows, ties, odd characters
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from the big house", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, "a", 0),
    (4, " \t\n  ", "de", None, 5),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (7, LONG + "tail", None, None, 1),
    (7, "another text with the same id", "en", "a", 1),
    (8, "a", "fr", "a", 1),
    (9, "日本語 テキスト　全角 ▁▁ <s> <|endoftext|> é é ﬁ ½", "ja", "a", 1),
    (None, "the quick brown fox jumps over the lazy dog and runs far away from the big house", "en", "a", 1),
    (None, None, None, None, None),
    (10, "1234 5678 ... !!! ###", "en", "a", 1),
    (11, "x" * 5000, "en", "a", 1),
    (12, "ab " * 400, "en", "a", 1),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASH = ["h", "c", "w", "rid", "tag", "key", "rep", "lead", "bucket", "guest", "gram", "n", "id", "ids", "of", "parts", "fp", "label", "row", "ranges", "block"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clash_docs(odd_docs):
    return odd_docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
