import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PASSAGE = " ".join(f"w{i}" for i in range(60)) + "."


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest test data."""
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names clash with those used inside."""
    long_text = "\n".join(f"line {i} has word{i} and word{i + 1} in it. " * 3 for i in range(4000))
    own = " ".join(f"own{i}" for i in range(80))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n\x0b", None, "a", 4), (4, long_text, "en", "b", len(long_text)),
        (5, own, "en", None, 1), (5, own, "en", None, 1), (None, own, "de", "a", 1), (None, None, None, None, None),
        (6, own + " x", "en", "a", 1), (7, "one", "en", "a", 3), (8, "Straße ÉÉ ß 東京   x", "de", "a", 9),
        (9, PASSAGE, "en", "a", 1), (10, "before. " + PASSAGE + " after.", "en", "a", 1), (5, "another text of id five", "fr", "b", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = "text_hash row host kept n_words spans score held_out component_id copy n_copies rate lines kinds word c key label prints x id members t"
    for name in names.split():
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.withColumn("vector", F.array(F.lit(1.0)))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
