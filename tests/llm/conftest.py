import pytest

EXTRA = ", node string, words int, key string, removed string, score double"


@pytest.fixture
def awkward(spark):
    """Nulls, empty and wordless texts, ties, repeated rows, a long text, and columns with clashing names."""
    body = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, body, "x", 1, "k", "r", 0.5),
        (2, body, None, None, None, None, None),
        (3, None, "x", 1, "k", "r", 0.5),
        (4, "", "x", 1, "k", "r", 0.5),
        (5, " \n\t ", "x", 1, "k", "r", 0.5),
        (6, "two words", "x", 1, "k", "r", 0.5),
        (6, "two words", "x", 1, "k", "r", 0.5),
        (None, body, "x", 1, "k", "r", 0.5),
        (7, "long " * 40_000 + "end", "x", 1, "k", "r", 0.5),
        (8, "é" * 300 + " ß中文 \U0001f600 +1 (555) 555-1234 a@b.co", "x", 1, "k", "r", 0.5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string" + EXTRA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string" + EXTRA)
