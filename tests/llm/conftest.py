import pytest
from cases import AWKWARD, DOCS


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and other columns whose names clash with results."""
    rows = [(i, t, "en", None, "clash", 0) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, sequence_id string, score int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
