"""Every registered query against its SQL in DuckDB."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import TABLES, rows_of, whole_numbers  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from slotframe import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df, rel = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(whole_numbers(df.toPandas(), dict(df.dtypes))) == rows_of(whole_numbers(rel.df(), dict(zip(rel.columns, rel.types))))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
