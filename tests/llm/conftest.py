import pytest

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog. password=abcdefgh12345678 end", "a"),
    (2, "The quick brown fox jumps over the lazy dog.  password=abcdefgh12345678 end\n", "a"),
    (3, None, None),
    (4, "", "b"),
    (5, " \t\n\x0b\x0c\r ", "b"),
    (6, "one two three " * 4000, "b"),
    (7, "Licensed under the Apache License, Version 2.0. ünïcödé 日本語 🎉 <|endoftext|> don't  stop", "c"),
    (8, "unique words only appear here once and never again", "c"),
    (8, "unique words only appear here once and never again", "c"),
    (None, "a row without id", "c"),
    (9, "x" * 200_000, ""),
    (10, "the quick brown fox jumps over the lazy dog password=abcdefgh12345678 end", None),
]
SCHEMA = "doc_id bigint, text string, source string, kept boolean, digest string, set string, task int, `row` string, host string, lang string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the operators' own names."""
    rows = [(i, t, s, None, "d", "s", 1, "r", "h", "en", len(t or "")) for i, t, s in DOCS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "text")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
