"""Compare a Spark result with DuckDB's on the same parquet tables, order-insensitively."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import time

import duckdb


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return _rows([d[0] for d in cur.description], cur.fetchall())


def compare(spark, sf_dir: str, name: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    cols, got = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    out = {"name": name, "rows": len(got), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        return out | {"status": "rows-only"}
    ocols, want = duck_rows(duck(sf_dir), sql)
    out["duck_sec"] = round(time.time() - t1, 2)
    if cols != ocols:
        return out | {"status": "SCHEMA", "detail": f"{cols} != {ocols}"}
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        miss = [r for r in want if r not in set(got)][:2]
        return out | {"status": "VALUES", "detail": f"rows {len(got)} vs {len(want)}\n  extra {str(extra)[:900]}\n  missing {str(miss)[:900]}"}
    return out | {"status": "ok"}
