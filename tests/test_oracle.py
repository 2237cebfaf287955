"""Every query with SQL, held to DuckDB on the smallest tables."""

import math
import os

import pytest

from causalpanel import catalog

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v) + 0.0:.6g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)[:10] if hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    d = catalog.QUERIES[name](spark, SF)
    rel = duck.sql(catalog.SQL[name])
    columns = sorted(d.columns)
    assert columns == sorted(rel.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in d.collect())
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted(tuple(shown(r[k]) for k in at) for r in rel.fetchall())
