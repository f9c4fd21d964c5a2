"""What SQL can express of the operators, against DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pytest

from trackloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.startswith("base_")])
def test_base_columns(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rel = con.sql(queries.oracle_sql()[name])
    want = [tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()]
    assert sorted(rel.columns) == columns
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want))
