"""Every query that has SQL, against DuckDB over the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return bytes(value) if isinstance(value, (bytearray, memoryview)) else value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([_plain(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    assert _rows(got.collect(), got.columns) == _rows(want.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
