"""Every query against its SQL twin, run by DuckDB on the same files."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return "nan" if math.isnan(value) else repr(float(value) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    result = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_runs(spark):
    df = driver.entry(spark)
    assert df.count() > 0
    assert "risk_level" in df.columns
