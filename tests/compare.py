"""Runs registered queries next to their oracle SQL."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """What differs between query and oracle, or None."""
    df = fn(spark, sf_dir)
    got = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = normal_rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    names = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "timestamp": "TIMESTAMP"}
    for column, kind in df.dtypes:
        if names.get(kind, kind) != kinds[column]:
            return f"type of {column}: {kind} != {kinds[column]}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows != {len(want)} rows; only query: {str(only_got)[:1500]}; only oracle: {str(only_want)[:1500]}"
    return None if want else "no rows"


def main(sf_dir: str, names: list[str]) -> None:
    from corpusloom.queries import ORACLES, QUERIES
    from corpusloom.session import build_session

    spark = build_session("local[4]", "compare", spark__sql__shuffle__partitions=8, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            diff = difference(spark, con, sf_dir, fn, ORACLES[name]) if name in ORACLES else "no oracle"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name:28s} {time.time() - start:6.2f}s {diff or ''}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    main(sys.argv[1], sys.argv[2:])
