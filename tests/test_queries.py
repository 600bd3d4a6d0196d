"""Every query against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from waynet.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return float(v) if hasattr(v, "as_tuple") else v

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


def sql_rows(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    rows = found.fetchall()
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), [tuple(r[i] for i in order) for r in rows]


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    rows = [tuple(r) for r in out.select(*columns).collect()]
    assert rows
    if name in ORACLES:
        names, expected = sql_rows(ORACLES[name])
        assert names == columns
        assert plain(rows) == plain(expected)
