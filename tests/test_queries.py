"""Every reference query against its SQL on the smallest tables."""

import duckdb
import pytest

from cinequery.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    columns = sorted(got.column_names)
    rows = sorted((tuple(r[c] for c in columns) for r in got.to_pylist()), key=str)
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).to_arrow_table()
        assert sorted(want.column_names) == columns
        assert rows == sorted((tuple(r[c] for c in columns) for r in want.to_pylist()), key=str)
