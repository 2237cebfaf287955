"""The queries with SQL, held to DuckDB on the smallest tables."""

import os

import pytest

from causalpanel.llm import queries

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    d = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    columns = sorted(d.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in d.collect())
    assert mine == sorted(tuple(shown(r[k]) for k in at) for r in rel.fetchall())
