"""The corpus queries that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from gridsquall.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = c.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    rows = {tuple(r[k] for k in columns) for r in got.collect()}
    assert rows == set(c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name].strip()})").fetchall()) and rows
