import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text[, source[, lang]]) rows."""
    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]))
                for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [(1, None, "a"), (2, "", None), (3, "   \n\t ", "a"), (None, "one two three", "b"), (None, None, None),
            (5, "same words in this short text here", "a"), (6, "same words in this short text here", "b"),
            (7, "repeated row", "c"), (7, "repeated row", "c"), (8, long_text, "a"), (9, long_text + " more", "a"),
            (10, "aaaaaaaa" * 20_000, "b"), (11, "1" * 50_000, "b"), (12, "été 漢字 😀 \x1c x", "c", None)]


@pytest.fixture
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return make
