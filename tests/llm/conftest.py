import pytest

from hiresift.llm.common import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as a table that also holds columns of clashing names."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", 0.5, 1) for i, t in rows], "doc_id long, text string, lang_pred string, score double, node int")
    return make
