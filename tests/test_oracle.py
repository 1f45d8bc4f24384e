"""Every registered query against its SQL in DuckDB."""

import pytest

from conftest import SF
from tablescope.registry import all_entries
from tools.compare import compare, connect

ENTRIES = all_entries()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql])
def test_agrees_with_sql(spark, db, name):
    query, sql = ENTRIES[name]
    assert compare(query(spark, SF), sql, db) == []


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if not sql])
def test_runs(spark, name):
    assert ENTRIES[name][0](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 11
    assert driver.oracle_sql().keys() <= driver.queries().keys()
