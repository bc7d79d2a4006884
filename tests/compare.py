"""Run registered queries next to their SQL and compare rows exactly.

Usage: python -m tests.compare SF_DIR [query ...]
"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows; e.g. {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"\n  spark {str(a)[:600]}\n  sql   {str(b)[:600]}"
    return None


if __name__ == "__main__":
    from tests.conftest import new_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = new_session(), connect(sf_dir)
    bad = []
    for name in names or queries():
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            if names:
                traceback.print_exc()
        if problem:
            bad.append(name)
        print(f"{name:24s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{len(bad)} differ: {bad}")
