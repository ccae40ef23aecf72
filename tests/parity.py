"""Compare queries with their SQL on DuckDB: ``python -m tests.parity <data dir> [names]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

import duckdb

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def duck(data: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted(repr(tuple(_cell(row[at]) for at in order)) for row in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a query, empty if there are none."""
    problems = []
    relation = con.sql(sql)
    wanted = dict(zip(relation.columns, map(str, relation.types)))
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sorted(wanted) != sorted(have):
        return [f"columns {sorted(have)} != {sorted(wanted)}"]
    for name, kind in have.items():
        if TYPES.get(kind) != wanted[name]:
            problems.append(f"type of {name}: {kind} != {wanted[name]}")
    ours = _rows(df.collect(), df.columns)
    theirs = _rows(relation.fetchall(), relation.columns)
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows != {len(theirs)}")
    if ours != theirs:
        extra, missing = set(ours) - set(theirs), set(theirs) - set(ours)
        problems.append(f"only here {sorted(extra)[:2]}; only there {sorted(missing)[:2]}")
    return problems or ([] if ours else ["no rows"])


def main(data: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from wardline import session

    spark = session.build(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = duck(data), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problems = compare(build(spark, data), con, oracle[name])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{name:28s} {time.time() - start:6.2f}s {'; '.join(problems) or 'ok'}", flush=True)
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
