"""Compare registered queries with their SQL in DuckDB. ``python tests/compare.py [sf_dir] [names…]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    result = con.execute(sql)
    return rows_of([c[0] for c in result.description], result.fetchall())


def difference(df, con, sql, clock=None) -> str | None:
    got_columns, got = spark_rows(df)
    if clock is not None:
        clock.append(time.time())
    want_columns, want = sql_rows(con, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {str(g)[:600]} != {str(w)[:600]}"
    return None if got else "empty"


if __name__ == "__main__":
    from shotweave.session import local_session
    from shotweave.workloads import QUERIES, SQL

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start, clock = time.time(), []
        try:
            if name in SQL:
                problem = difference(QUERIES[name](spark, folder), con, SQL[name], clock)
            else:
                problem = None if QUERIES[name](spark, folder).count() else "empty"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:28s} {(clock or [time.time()])[0] - start:6.1f}s {time.time() - start:6.1f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{bad} of {len(names)} differ")
