import pytest


@pytest.fixture
def frame(spark):
    """Rows (doc_id, text, ...) as a table in several partitions, with columns whose names the operators use inside."""

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "'x' AS node", "1 AS tag", "2 AS n", "'y' AS `key`").repartition(3)

    return make
