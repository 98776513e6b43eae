import duckdb
import pytest

import __spark_entry__
from prismal import queries as engine

ORACLES = engine.oracle_sql()


@pytest.fixture(scope="module")
def db():
    import glob
    import os

    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, db, name):
    got = engine.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(db.sql(f"SELECT * FROM ({ORACLES[name]})").columns) == cols
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))


def test_contract(spark):
    assert __spark_entry__.entry(spark).columns == ["c_custkey", "o_orderkey", "l_partkey"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_sql(spark, sf):
    got = {r["query"]: (r["weight"], r["cost"]) for r in engine.queries()["q_cost_table"](spark, sf).collect() if r["cost"] is not None}
    assert got["mean"][1] == pytest.approx(0.6 * got["paren_in"][1] + 0.4 * got["vertical"][1])
