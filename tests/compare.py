"""Run registered queries against their SQL: ``python tests/compare.py FOLDER [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from sitewarden.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return f"{type(value).__name__}:{value}"


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, folder: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.queries()[name](spark, folder)
    mine = normal(df.columns, df.collect())
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: {len(mine)} rows, no SQL, {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = normal(names, cur.fetchall())
    text = f"{name}: {len(mine)} rows, {took:.1f}s, sql {time.time() - start:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"{text} COLUMNS {sorted(df.columns)} {sorted(names)}"
    if mine != theirs:
        a, b = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
        return False, f"{text} DIFFER ({len(theirs)} rows in SQL)\n   mine {a}\n   sql  {b}"
    return True, text


def main() -> None:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name in wanted or entry.queries():
        try:
            ok, text = check(spark, con, folder, name)
        except Exception as e:  # keep going, report at the end
            ok, text = False, f"{name}: ERROR {str(e)[:1500]}"
        print("ok  " if ok else "BAD ", text, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
