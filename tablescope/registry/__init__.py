"""Every operator as a query over the test tables, next to the SQL that must give the same rows."""

from __future__ import annotations

import importlib

from .common import Entry

MODULES = ("profile", "analysis", "records")


def all_entries() -> dict[str, Entry]:
    entries: dict[str, Entry] = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        repeated = entries.keys() & module.QUERIES.keys()
        assert not repeated, repeated
        entries.update({key: (_pinned(query), sql) for key, (query, sql) in module.QUERIES.items()})
    return entries


def _pinned(query):
    """The queries compare timestamps without zone, so the session zone is UTC whatever the session's default."""

    def run(spark, sf):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf)

    return run
