import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank, very long, repeated and tied rows."""
    words = [f"w{k}" for k in range(400)]
    long = " ".join(words * 60)
    base = " ".join(words[:120])
    near = " ".join([*words[:115], "x", *words[116:120]])
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "de", None), (4, base, None, "b"), (4, base, None, "b"), (5, None, "en", "b"), (6, "", "de", "b"), (7, " \n\t ", "fr", "b"),
        (8, long, "en", "c"), (9, "one two", "en", "c"), (10, "ONE two", "de", "c"), (None, "a text without an id", "en", "c"), (None, None, None, None), (11, "12 34 !!", "en", "a"),
        (12, "日本語 テキスト é ß İ K   x\x1fy <|endoftext|> z", "fr", "a"), (13, "a" * 50_000, "fr", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
