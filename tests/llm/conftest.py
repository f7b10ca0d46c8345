import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, label string"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, repeated rows and clashing extra columns."""
    long_text = " ".join(f"word{i % 700}" for i in range(20_000))
    rows = [
        (1, None, "en", "a", 0, "x", "y", "z"),
        (2, "", "en", None, 0, None, None, None),
        (3, " \t\n ", None, "a", 4, "x", "y", "z"),
        (4, long_text, "en", "a", len(long_text), "x", "y", "z"),
        (4, long_text, "en", "a", len(long_text), "x", "y", "z"),
        (5, "Ein kleiner Text\nEin kleiner Text\n", "de", "b", 34, "x", "y", "z"),
        (None, "one two three four", "en", "b", 18, "x", "y", "z"),
        (7, "\U0001f600 é *** \x01 ###", None, None, 10, "x", "y", "z"),
        (8, "two words", "en", "b", 9, "x", "y", "z"),
        (9, "TWO words", "en", "b", 9, "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def marks(spark):
    rows = [(1, 1, 0), (3, 0, 1), (4, 1, 1), (4, 1, 0), (5, None, 1), (None, 1, 1), (8, 0, 0), (99, 1, 1), (9, 7, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
