"""Run registered queries against their SQL: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = Path("/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between both results: names, types, counts or rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    columns = sorted(names)
    if sorted(spark_df.columns) != columns:
        return [f"columns {sorted(spark_df.columns)} != {columns}"]
    problems = []
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    for name, kind in spark_df.dtypes:
        if kinds.get(kind, kind) != types[name]:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    order = [names.index(c) for c in columns]

    def key(row):
        return tuple((v is None, str(v)) for v in row)

    wanted = sorted((tuple(r[i] for i in order) for r in expected), key=key)
    found = sorted((tuple(r) for r in spark_df.select(*columns).collect()), key=key)
    if len(found) != len(wanted):
        problems.append(f"rows {len(found)} != {len(wanted)}")
    extra, missing = set(found) - set(wanted), set(wanted) - set(found)
    if extra or missing or found != wanted:
        problems.append(f"{len(extra)} rows too many, {len(missing)} rows missing")
        problems += [f"  + {str(r)[:400]}" for r in sorted(extra, key=key)[:2]]
        problems += [f"  - {str(r)[:400]}" for r in sorted(missing, key=key)[:2]]
    return problems


def main() -> None:
    import __spark_entry__ as entry
    from shelfmark.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    sf_dir = str(DATA / sf)
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, query in entry.queries().items():
        if name not in entry.oracle_sql() or wanted and name not in wanted:
            continue
        started = time.time()
        try:
            problems = differences(query(spark, sf_dir), con, entry.oracle_sql()[name])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok ':4}{name:28}{time.time() - started:7.2f}s", flush=True)
        for problem in problems:
            print("      " + problem, flush=True)
    print(f"{bad} differ")
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
