"""The operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from worldpulse.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    expected = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(x) for x in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in expected.fetchall())
