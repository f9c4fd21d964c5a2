"""Every query against its SQL in DuckDB, on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from trackloom.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 3) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    if name not in SQL:
        assert rows
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    want = [tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
