import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from texts (or (doc_id, text) or (doc_id, text, source) rows)."""
    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else r
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])))
        return spark.createDataFrame(full, DOCS)
    return make
