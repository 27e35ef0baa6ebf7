import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, score string, code string, size string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and columns with clashing names."""
    long_ = "word%d and more. " * 3000 % tuple(range(3000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "b", 0), (3, " \n\t ", "en", "b", 4), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7),
        (5, "one two", None, None, 7), (None, "one two three four", "en", "a", 1), (None, None, None, None, None), (6, long_, "en", "c", len(long_)), (7, long_ + "x", "en", "c", 1),
        (8, "é" * 50 + "\U0001f600 \x00 <|endoftext|> <|im_end|> mail a@b.co", "fr", "\U0001f600", 3),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
