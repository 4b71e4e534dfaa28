"""Every registered query against its SQL twin on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from checks import registry
from checks.all import load
from checks.run import TABLES, rows

FOLDER = Path("/root/testdata/sf0.001")
load()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, str(FOLDER))
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in registry.TWINS:
        cursor = db.execute(registry.TWINS[name])
        names = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, got) == rows(names, cursor.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 4
