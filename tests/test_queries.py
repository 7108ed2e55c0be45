"""Every registered query with SQL gives the same rows in Spark and DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 5)
    return str(value)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    frame = entry.queries()[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect()), key=str)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    place = [cols.index(c) for c in sorted(cols)]
    assert sorted(cols) == sorted(frame.columns)
    want = sorted((tuple(plain(r[i]) for i in place) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry_and_registry(spark):
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert entry.entry(spark).columns[0] == "pair_id"
