import pytest

#: Nulls, empty and long texts, repeated rows, ties, and extra columns whose names clash with those used inside.
ROWS = [
    (1, "the cat sat on the mat", "en", "a", 1, "x"), (2, "the  cat\tsat on the mat", "en", "b", 2, "y"), (2, "the  cat\tsat on the mat", "en", "b", 2, "y"), (3, None, None, None, None, None),
    (4, "", "en", "a", 0, "z"), (None, "no id here at all", "en", "a", 3, "n"), (5, "word " * 40_000, "en", "a", 9, "long"), (6, "x" * 300_000, "es", "c", 9, "one token"), (7, " \n ", "en", None, 1, "w"),
    (8, "the cat sat on the mat today", "en", "c", 1, "v"), (9, "THE CAT sat on the mat", "en", "c", 1, "u"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size long, score string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(2)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
