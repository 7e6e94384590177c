import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    # names that results or inner steps use too
    T.StructField("score", T.StringType()), T.StructField("size", T.StringType()), T.StructField("_text", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("n", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Rows of (doc_id, text, lang, source)."""
        return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    return make_docs([
        (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"),
        (2, None, "en", "b"), (3, "", None, None), (None, "one two three four five six seven", "en", "a"), (None, None, None, None),
        (4, " \t\n\x0b ", "fr", "b"), (5, long, "en", "c"), (6, long + " end", "en", "c"), (7, "42 !!", "de", ""), (8, "ONE", "en", "a"),
        (8, "another text under one id", "en", "a"), (9, "\n\n\n", "en", "a")])
