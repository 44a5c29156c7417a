import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size int, code string, spans int, _row int"


@pytest.fixture(scope="session")
def messy():
    """Rows with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    words = "the quick brown fox jumps over the lazy dog near a quiet river bank today".split()
    prose = " ".join(f"{w}{i % 7}" for i in range(30) for w in words)
    rows = [
        (1, prose, "en", "src0"), (2, prose, "en", "src0"), (3, prose + " more", "en", "src1"), (None, None, None, None),
        (4, "", "en", "src0"), (5, None, "de", "src2"), (6, "   \n\t ", "fr", None), (7, "one", None, "src3"),
        (8, "x " * 30_000, "en", "src0"), (9, "y" * 50_000, "en", "src0"), (10, "password = hunter22 and AKIA" + "Q" * 16, "en", "src1"),
        (10, "password = hunter22 and AKIA" + "Q" * 16, "en", "src1"), (10, "another text under the same id", "en", "src1"),
        (None, "a text without an id that is long enough to be read by all", "en", "src0"), (11, "größe 😀 token: 'abc_def-ghi' " + "0123456789abcdef" * 3, "de", "src2"),
        (12, "# $ % & | < > * # $ % & | < > *", "en", "src0"), (13, "Line one here\nLine one here\nLine one here", "en", "src0"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "w", 1, "c", 2, 3) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def docs(spark, messy):
    return spark.createDataFrame(messy, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([], T.StructType.fromDDL("doc_id long, quality int, toxic int"))
