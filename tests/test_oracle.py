"""Every query with SQL against DuckDB on the small tables."""

import math

import duckdb
import pytest

from factorloom.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda v: (v is None, str(type(v)), v if not (isinstance(v, float) and math.isnan(v)) else 0)
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [key(v) for v in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = _plain([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = _plain(cur.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and abs(x - y) <= 2e-6) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
