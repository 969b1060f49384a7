import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bits string, id string, score string, _n string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, one very long text, clashing extra columns."""
    long = " ".join(f"w{i % 997}x{i // 997}" for i in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(40))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n ", "de", "b"),
        (5, "word", "de", "b"),
        (6, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (6, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (None, "no id but words enough to make a few shingles here", None, "c"),
        (None, None, None, None),
        (7, long, "fr", "a"),
        (8, passage + " own tail one", "en", "b"),
        (9, "own head two " + passage, "en", "c"),
        (10, passage.upper(), "en", None),
        (11, "Ünïcode ✓ naïve çà 日本 \u00a0non-breaking \u2003em", "es", "é"),
        (12, "x" * 5000, "en", "a"),
        (13, "a a a a a a a a a a a a a a a a a a a a", "en", "b"),
        (14, "a a a a a a a a a a a a a a a a a a a a", "en", "b"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "1", "2", "3", "4", "5") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 1, 1), (9, 0, None), (None, 1, 1), (11, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def vectors(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType())])
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.99, 0.01]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (200, [2.0, 2.0]), (11, [-1.0, 0.5]), (12, [1.0, 0.0]), (13, [])]
    return spark.createDataFrame([(i, v, None, "x") for i, v in rows], schema)
