"""Compare registered queries with their DuckDB twins: `python tests/oracle_check.py [sf_dir] [name...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark_df, con, sql: str) -> str | None:
    names = sorted(spark_df.columns)
    ours = sorted((tuple(normal(r[n]) for n in names) for r in spark_df.collect()), key=key)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != names:
        return f"columns differ: {names} / {sorted(columns)}"
    at = [columns.index(n) for n in names]
    theirs = sorted((tuple(normal(r[i]) for i in at) for r in found.fetchall()), key=key)
    if len(ours) != len(theirs):
        return f"rows differ: {len(ours)} / {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"first difference in {names}:\n    {a}\n    {b}"
    return None


def main(argv: list[str]) -> int:
    from swipesight.plans import catalog
    from swipesight.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle-check", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, query in catalog.entries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            if query.sql:
                problem = compare(query(spark, sf_dir), con, query.sql)
            else:
                problem = None if query(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "ok" if query.sql else "ran"
        print(f"{kind if problem is None else 'BAD':4}{time.time() - start:7.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
