from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text, source, lang) of the smallest table, on the driver."""
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, blanks, ties, repeats, a long text, and columns that clash with inner names."""
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "   \t", "de", "b"), (4, "word", "en", None), (4, "word", "en", None), (None, "no id here", "en", "a"), (5, "x " * 60_000, "en", "a"), (6, "日本語です 123 !!", None, "ü"), (7, "All rights reserved. <b>cc by</b> idiot\x00", "fr", "b")]
    return [(i, t, lang, s, len(t or ""), 1, 2, "k", 0.5) for i, t, lang, s in rows]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long, size long, part int, item string, score double")


@pytest.fixture
def empty(spark, odd):
    return odd.limit(0)
