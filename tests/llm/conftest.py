import pytest
from pyspark.sql import types as T

EDGE = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n \r", "en", "a"),
    (None, "text without an id but with words enough for one shingle", None, "a"),
    (4, "one two three four five six seven", "en", None),
    (4, "one two three four five six seven", "en", None),
    (5, "ONE two  three\tfour five six seven", "en", "b"),
    (6, "é́ ÄÖÜ ß 日本語 <|endoftext|> It's 12\x00 😀\n\na line of text\n", "de", "ı"),
    (7, "word " * 30_000, "en", "b"),
    (8, "\n".join(["a line of text", " A LINE OF TEXT\t", "short", "a line of text"]), "fr", "b"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empties, repeated rows, a long text, odd characters, and an extra column whose name clashes."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n", T.StringType()), T.StructField("h1", T.StringType()), T.StructField("score", T.StringType()), T.StructField("rate", T.StringType())])
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", "q") for r in EDGE], schema)


@pytest.fixture(scope="session")
def none(edge):
    return edge.filter("false")
