import pytest


@pytest.fixture(scope="session")
def tiny(spark):
    """Rows of (doc_id, text, lang) with nulls, empty and long texts, ties and repeats; columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "The quick brown fox jumps over the lazy dog. It runs away!", "en"), (2, "the QUICK brown fox jumps over the lazy dog. it runs away!", "en"),
            (3, None, "en"), (4, "", None), (5, "   \n\t ", "de"), (6, "?!... 123", "de"), (7, long, "en"), (8, long + " end", "en"), (9, "one two", "fr"),
            (10, "one  two", "fr"), (10, "one  two", "fr"), (None, "one two", None), (11, "Ünïcödé ß 日本語 K", "de")]
    return spark.createDataFrame([(*r, 0, "x", r[0]) for r in rows], "doc_id long, text string, lang string, n int, component string, `id` long")


@pytest.fixture(scope="session")
def none(tiny):
    return tiny.where("1 = 0")
