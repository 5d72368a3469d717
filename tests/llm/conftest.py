import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Documents with nulls, empty and long texts, repeated rows, and an extra column with a clashing name."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("Score", T.StringType())])
    words = [f"w{i % 97}x{i % 53}" for i in range(30000)]
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    data = [
        (1, base, "en", "a"), (2, base + " tail", "en", None), (3, base.upper(), "fr", "c"), (3, base.upper(), "fr", "c"),
        (4, None, None, None), (5, "", "en", ""), (6, " \n\t ", "en", "x"), (7, "one two", "de", "y"), (8, "one two", "de", "y"),
        (9, " ".join(words), None, "z"), (10, "été œuvre 日本 🙂 idiot! Fine day.", "fr", None), (None, "lost id text", "en", "q"),
    ]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def nothing(rows):
    return rows.limit(0)
