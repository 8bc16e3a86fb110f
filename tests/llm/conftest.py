import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tests.conftest import SMALL

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("score", StringType()), StructField("size", StringType())])

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30000))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, repeated rows and ties; score and size are columns that clash."""
    body = "the quick brown fox jumps over the lazy dog near the river bank every single day"
    rows = [
        (1, None, "en", "a", 3, "x", "y"),
        (2, "", "en", None, 0, None, None),
        (3, "   \n\t ", None, "b", 6, "x", "y"),
        (4, body, "en", "b", len(body), "x", "y"),
        (4, body, "en", "b", len(body), "x", "y"),
        (5, body + " again", "en", "c", len(body) + 6, None, "y"),
        (6, LONG, "en", "a", len(LONG), "x", "y"),
        (None, "write to ann@example.com or call +1 555 010 9999 now", "en", None, 52, "x", "y"),
        (8, "é ñ 日本 語 ß \u0085 x", None, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
