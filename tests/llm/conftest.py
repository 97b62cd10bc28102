import pytest

COLUMNS = "doc_id long, text string, lang string, score double, size long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, "the same text here", "en", 0.1, 1),
        (2, "the same text here", "en", 0.1, 1),
        (2, "the same text here", "en", 0.1, 1),
        (None, "the same text here", None, None, None),
        (None, None, None, None, None),
        (3, None, "fr", 1.0, 2),
        (4, "", "de", 0.0, 3),
        (5, " \t\n ", None, 0.0, 3),
        (6, "0123 4567 !!!", "en", 0.0, 3),
        (7, "long wörd 中文 😀 " * 4000, "en", 0.0, 3),
        (8, "x" * 70_000, "en", 0.0, 3),
    ]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
