import pytest
from pyspark.sql import DataFrame

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Texts, or (doc_id, text) pairs, as a table with documents' columns and some with names that operators use inside."""

    def make(texts, lang="en") -> DataFrame:
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], DOCS)
        return df.selectExpr("*", "'x' AS norm", "1 AS content", "2 AS cls", "'y' AS h", "3 AS row", "4 AS run", "5 AS size", "6 AS n", "7 AS sh", "8 AS score", "9 AS hit", "10 AS id", "11 AS held_out")

    return make


def words(n, start=0, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(start, start + n))


@pytest.fixture(name="words")
def words_fixture():
    return words
