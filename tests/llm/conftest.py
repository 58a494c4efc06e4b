import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, key string"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs, with further columns whose names operators also use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k") for i, t in rows], SCHEMA)

    return make
