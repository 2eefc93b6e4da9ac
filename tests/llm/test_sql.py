"""The queries that SQL can express against DuckDB, on whole tables."""

import duckdb
import pytest

from factorloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equals_sql(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cur = c.execute(queries.ORACLE_SQL[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    got = queries.QUERIES[name](spark, folder)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
