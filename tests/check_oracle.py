"""Run registered queries in Spark and their SQL in DuckDB and compare all values.

    python tests/check_oracle.py [sf_dir] [name …]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from tandem.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.6f}" if isinstance(v, float) else str(v)
    return str(v)


def compare(spark, con, sf, name):
    """(matches, message, Spark seconds)"""
    t = time.time()
    df = entry.queries()[name](spark, sf)
    rows, columns = [tuple(r) for r in df.collect()], df.columns
    seconds = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return bool(rows), f"rows only: {len(rows)}", seconds
    print(f"     {name}: Spark {seconds:.2f}s, now SQL", file=sys.stderr, flush=True)
    result = con.sql(sql)
    kinds = {c: str(t) for c, t in zip(result.columns, result.types)}
    want, want_columns = canonical(result.fetchall(), result.columns)
    got, got_columns = canonical(rows, columns)
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}", seconds
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return False, f"{len(got)} rows, SQL {len(want)}; only Spark {list(a)[:2]} only SQL {list(b)[:2]}"[:900], seconds
    for c, t in df.dtypes:
        pair = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
        if pair.get(t) != kinds[c]:
            return True, f"ok, {len(got)} rows; type of {c}: {t} / {kinds[c]}", seconds
    return True, f"ok, {len(got)} rows", seconds


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("check", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), 0
    for name in names:
        try:
            ok, message, seconds = compare(spark, con, sf, name)
        except Exception as e:  # report and go on
            ok, message, seconds = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        failed += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name} {seconds:.2f}s {message}", flush=True)
    print(f"{failed} failed of {len(names)}")
    spark.stop()


if __name__ == "__main__":
    main()
