"""Compare registered queries with their SQL counterparts run by DuckDB on the same files.

    python tests/compare.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, db, folder: str, query, sql: str) -> str | None:
    frame = query(spark, folder)
    got = rows_of(frame.columns, frame.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} / {sorted(names)}"
    expected = rows_of(names, result.fetchall())
    if got == expected:
        return None
    only_spark, only_sql = list(set(got) - set(expected))[:3], list(set(expected) - set(got))[:3]
    return f"{len(got)} rows / {len(expected)} rows; only in Spark {only_spark}; only in SQL {only_sql}"


def main(folder: str, prefixes: list[str]) -> int:
    from fleetledger.plans.registry import registered
    from fleetledger.session import build_session

    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = connect(folder), 0
    for name, (query, sql) in registered().items():
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        start = time.time()
        try:
            problem = differences(spark, db, folder, query, sql) if sql else f"no SQL, {query(spark, folder).count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem and sql)
        print(f"{name:28} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
