import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns named like those that operators make themselves.
EXTRA = ("id", "mark", "key", "row", "size", "node", "h1", "n", "words", "kept", "score", "slot")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text, source) with extra columns whose names clash."""

    def build(rows):
        frame = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)
        from pyspark.sql import functions as F

        return frame.withColumns({c: F.lit("x") for c in EXTRA})

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls everywhere, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    return make([
        (1, None, "a"), (2, "", None), (3, "one two three four five six", "a"), (3, "one two three four five six", "a"), (None, "one two three four five six", "b"), (None, None, None),
        (4, long, "a"), (5, long + " end", "b"), (6, " \n\t", "c"), (7, "a\n\nb\nA \nb", "c"), (8, "ñandú 中文  x", ""), (9, "x", "a"),
    ])


@pytest.fixture(scope="session")
def empty(make):
    return make([])
