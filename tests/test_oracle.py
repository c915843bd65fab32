"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os
from collections import Counter

import duckdb
import pytest

from stackwright.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, duck):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    names = want.columns
    assert rows == Counter(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in want.fetchall())
