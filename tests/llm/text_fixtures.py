import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from texts, or from (doc_id, text) pairs; further columns as given."""

    def make(rows, source="s"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            [(i, t, "en", source, len(t or ""), "x", 1) for i, t in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint, gram string, node int",
        )

    return make
