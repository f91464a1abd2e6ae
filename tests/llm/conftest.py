import pytest

CLASHING = ["doc", "row", "number", "id", "hash", "fp", "words", "rank", "size", "start", "ids", "base", "picks", "block", "target"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * len(CLASHING))


PROSE = "the quick brown fox jumps over a lazy dog and runs along the river bank while nobody is looking at it again "


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows and ids, columns with clashing names."""
    rows = [
        _row(1, PROSE + "one two three four five"), _row(2, PROSE + "one two three four five"), _row(2, PROSE + "one two three four five"),
        _row(3, PROSE + "and something else here"), _row(3, "another text under the same id, call +1 (555) 010-9999 now"),
        _row(None, PROSE), _row(None, None, None, None), _row(4, None), _row(5, ""), _row(6, " \t\n  "), _row(7, "a b"),
        _row(8, PROSE * 3000, "en", None), _row(9, "é" * 70_000, None, "b"), _row(10, "12345 67890 !!", "de", ""),
        _row(11, "mail me@example.org or 10.0.0.1 and 4111 1111 1111 1111 ok", "en", "b"), _row(12, "ß \U0001F600 日本語 \x00 text", "de", "b"),
        _row(13, "Licensed under the Apache License, Version 2.0.", "en", "c"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 0), (None, 0, 1), (99, 1, 1), (11, 0, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
