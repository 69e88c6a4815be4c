import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, held_out string, id string"


@pytest.fixture(scope="session")
def documents(spark):
    """A function from (doc_id, text, lang) rows to a documents table with clashing extra columns."""

    def make(rows):
        full = [(i, t, lang, "s", None if t is None else len(t), "x", "y") for i, t, lang in rows]
        return spark.createDataFrame(full, DOCS)

    return make
