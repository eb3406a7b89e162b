"""Rows that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, score double, links long, gone string"


def words(n, seed=0):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 9973}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    long_text = words(30_000, 3)
    rows = [
        (1, words(60, 1), "en", "a"), (2, words(60, 1), "en", "a"), (2, words(60, 1), "en", "a"), (3, None, "en", None),
        (4, "", None, "a"), (5, " \n\t ", "de", "b"), (None, words(60, 1), None, None), (None, None, None, None),
        (6, long_text, "fr", "b"), (7, long_text + " tail", "fr", "b"), (8, "x" * 300_000, "de", "c"),
        (9, "ß ü 漢字 é\n" + words(80, 4), "de", "c"), (9, words(70, 5), "en", "c"), (10, "123 456 !!", "en", "é"),
        (11, "line one\nline two\n\nline one", "en", "é"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), -1, -2, -3.0, -4, "x") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
