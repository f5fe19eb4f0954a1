import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, pii string, kept boolean, sig string"


@pytest.fixture()
def docs(spark):
    """Rows of doc_id, text and perhaps source, with further columns whose names could clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, 8, "x", True, "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Nulls, empty and blank texts, repeated rows, one very long text.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (4, "a b c"), (None, "x y z"), (5, None, None), (6, "word " * 30_000)]
