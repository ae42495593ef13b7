import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a long, spans string, fp long, root long, blob string, size long, _id long, _times long, taken long, score double, key string"
ODD = [None, "", " \t\n", "one", "one two three four five six", "one two three four five six", "é" * 300, "x " * 5000, "a@b.co +1 (555) 010-2030 password=hunter22"]


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and clashing extra columns."""
    rows = [(i, t, None, f"s{i % 2}" if i % 3 else None, None, 1, "x", 7, 7, "b", 9, 1, 1, 1, 1.0, "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], rows[8], (None,) * 16], SCHEMA)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
