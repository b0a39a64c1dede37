"""Every mirror query against its SQL in DuckDB on the smallest tables, and the driver contract."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in want.columns) for r in df.collect()), key=str)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0
    assert catalogue.tables(spark, SF).count() > 0


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=entry.HERE, check=True, timeout=120)
