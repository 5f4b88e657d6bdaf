import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, words int, label string, score string, hits int, _id string, _row int, _ka int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs, empty and very long texts, ties, repeated rows, and further columns with names the operators use."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    plain = "the quick brown fox jumps over the lazy dog and runs away from the angry farmer"
    rows = [(1, plain), (2, plain), (2, plain), (3, None), (None, plain), (None, None), (4, ""), (5, "   \n "), (6, "!!! ???"), (7, long_text), (8, long_text), (9, "ééé ▁▁ 日本 \x00 x"), (10, "word")]
    return spark.createDataFrame([(i, t, "en", "s", 1, 0, "n", 3, "l", "s", 4, "x", 5, 6) for i, t in rows], DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
