"""The text queries that SQL can express, side by side with it."""

import duckdb
import pytest

from prismal.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
