from __future__ import annotations

import pytest

LONG = "wordy text goes on " * 3000
DOCS = [
    (1, "The cat sat on the mat and looked at the dog .", "en", "a", 1, "x"),
    (2, "The cat sat on the mat and looked at the dog .", "en", "a", 1, "x"),
    (2, "The cat sat on the mat and looked at the dog .", "en", "a", 1, "x"),
    (3, "Le chat est sur le tapis et regarde le chien .", "fr", "b", 2, None),
    (4, None, "en", None, None, "y"),
    (5, "", None, "a", 3, "y"),
    (None, "An id is missing here .", "en", "b", 4, "z"),
    (7, "12 34 !!", "en", "b", 4, "z"),
    (8, LONG, "en", "a", 5, "z"),
    (9, "a b", "fr", "a", 5, "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, shard int, kept string")


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.where("false")
