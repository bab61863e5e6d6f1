"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows.

    python tests/oracle.py [sf_dir] [query name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from gaugewright.plans.facts import SOURCES


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in SOURCES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: str, run, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = run(spark, folder)
    got = rows_of(df.columns, df.collect())
    result = connection.sql(sql)
    want = rows_of(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} <> {sorted(result.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sum(x != y for x, y in zip(got, want))} of {len(got)} rows differ\n   spark  {a}\n   duckdb {b}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from gaugewright.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark, connection, sqls = local_session(8), database(folder), oracle_sql()
    failed = 0
    for name, run in queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            found = compare(spark, connection, folder, run, sqls[name]) if name in sqls else f"rows only: {run(spark, folder).count()}"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None and not found.startswith("rows only")
        print(f"{name:36s} {time.time() - start:6.2f}s {found or 'ok'}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
