import pytest


@pytest.fixture
def docs(spark):
    """Rows from (doc_id, text) with clashing extra columns."""

    def make(rows):
        wide = [(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in rows]
        return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, n int, score string")

    return make
