import pytest


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) pairs, or from dicts, with the columns of the driver's table."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        full = [r if isinstance(r, tuple) and len(r) == 5 else (r[0], r[1], "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
