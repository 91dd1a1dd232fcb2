"""Every query of the library with an oracle, against DuckDB on the small tables."""

from pathlib import Path

import duckdb
import pytest

from tessera import queries

DATA = Path("/root/testdata/sf0.001")


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(repr([x.item() if hasattr(x, "item") else x for x in r]) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    assert rows(queries.QUERIES[name](spark, str(DATA)).toPandas()) == rows(con.sql(queries.ORACLES[name]).fetchdf())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).first().value == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
