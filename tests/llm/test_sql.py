"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from waynet.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    out = queries.queries()[name](spark, SF)
    columns = sorted(out.columns)
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    own = sorted((tuple(r) for r in out.select(*columns).collect()), key=repr)
    for a, b in zip(own, sorted(found, key=repr), strict=True):
        assert all(x == (pytest.approx(y) if isinstance(y, float) else y) for x, y in zip(a, b))
