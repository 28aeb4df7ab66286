"""Every registered query against its SQL, on the driver's smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__ as driver
from checks.queries import QUERIES as LOG_QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables absent")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_log_query_has_sql():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(LOG_QUERIES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", LOG_QUERIES)
def test_query(spark, database, name):
    frame = driver.queries()[name](spark, SF_DIR)
    result = database.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    got = sorted((tuple(row) for row in frame.select(*columns).collect()), key=repr)
    want = sorted(result.fetchall(), key=repr)
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["hour", "dim", "key", "requests"]
    assert frame.count() > 0
