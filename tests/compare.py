"""Run queries against DuckDB on the same tables and compare the rows in any order."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value)


def _key(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, (int, float)) else "n"), v if v is not None else 0) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=_key)


def compare(spark, con, run, sql, sf_dir):
    """None when equal, else a description of the first difference."""
    df = run(spark, sf_dir)
    columns, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(sql)
    sql_columns, right = rows_of(relation.columns, relation.fetchall())
    if columns != sql_columns:
        return f"columns {columns} != {sql_columns}"
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    sql_kinds = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    if kinds != sql_kinds:
        return f"types {kinds} != {sql_kinds}"
    if len(left) != len(right):
        extra = set(left) - set(right), set(right) - set(left)
        return f"{len(left)} rows != {len(right)} rows; only here {list(extra[0])[:3]}; only in SQL {list(extra[1])[:3]}"
    for a, b in zip(left, right):
        if a != b:
            return f"{dict(zip(columns, a))} != {dict(zip(columns, b))}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as contract
    from shardloom.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    session = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                            spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    duck = connect(sf)
    oracles = contract.oracle_sql()
    bad = 0
    for name, run in contract.queries().items():
        if len(sys.argv) > 1 and name not in sys.argv[1:]:
            continue
        begin = time.time()
        try:
            problem = compare(session, duck, run, oracles[name], sf) if name in oracles else (
                None if run(session, sf).count() else "no rows")
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{name:24s} {time.time() - begin:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print("failed:", bad)
