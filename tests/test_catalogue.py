"""Every registered query next to its SQL twin, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from check import canonical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 1


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
