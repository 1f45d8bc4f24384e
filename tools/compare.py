"""Run registered queries in Spark and DuckDB on one data folder and compare names, types and values.

usage: python tools/compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb

from tablescope.registry import all_entries
from tablescope.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return str(sorted(v.items()))
    return "null" if v is None else str(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


def spark_kind(t: str) -> str:
    return {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "binary": "BLOB", "date": "DATE"}.get(t, t)


def compare(df, sql: str, db) -> list[str]:
    """The differences between a Spark result and a SQL result; empty when they agree."""
    rows = [tuple(x) for x in df.collect()]
    result = db.sql(sql)
    expected = result.fetchall()
    names, left = canonical(df.columns, rows)
    wanted, right = canonical(result.columns, expected)
    problems = []
    if names != wanted:
        return [f"columns {names} != {wanted}"]
    kinds = {n: spark_kind(t) for n, t in df.dtypes}
    other = {n: str(t) for n, t in zip(result.columns, result.types)}
    for n in names:
        if kinds[n] != other[n]:
            problems.append(f"type of {n}: {kinds[n]} != {other[n]}")
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    if left != right:
        a, b = set(left), set(right)
        problems.append(f"values differ\n  columns  {names}\n  spark only {sorted(a - b)[:3]}\n  sql only   {sorted(b - a)[:3]}")
    return problems


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.001")
    args.add_argument("names", nargs="*")
    opt = args.parse_args()
    spark, db, bad = local_session(), connect(opt.sf), 0
    for name, (query, sql) in all_entries().items():
        if opt.names and not any(name.startswith(n) for n in opt.names):
            continue
        start = time.time()
        try:
            df = query(spark, opt.sf)
            if sql:
                problems = compare(df, sql, db)
                state = "ok"
            else:
                problems, state = [], f"rows-only {len(df.collect())}"
        except Exception:
            problems, state = [traceback.format_exc(limit=-3)[:1800]], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else state:12} {name} {time.time() - start:.2f}s", *problems, sep="\n   " if problems else " ", flush=True)
    print("failures:", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
