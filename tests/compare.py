"""Runs registered queries and their SQL side by side: python tests/compare.py [sf] [name part ...]"""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def normal(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else str(value)
    return repr(value)


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def sql_rows(sql, sf):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'").fetchall()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return columns, result.fetchall()


def difference(spark, name, fn, sql, sf):
    """None if query and SQL agree, else what differs; a query without SQL is not compared here."""
    if sql is None:
        raise ValueError(f"{name} has no SQL to compare with")
    df = fn(spark, sf)
    mine = [tuple(r) for r in df.collect()]
    columns, theirs = sql_rows(sql, sf)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = bag(mine, df.columns), bag(theirs, columns)
    if a == b:
        return None
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return f"{len(a)} rows != {len(b)} rows\n   spark {str(only_a)[:600]}\n   sql   {str(only_b)[:600]}"


if __name__ == "__main__":
    import __spark_entry__ as e

    from lagscope.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    oracle, bad = e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if len(sys.argv) > 2 and not any(p in name for p in sys.argv[2:]):
            continue
        if name not in oracle:
            print(f"none {name} has no SQL", flush=True)
            continue
        at = time.time()
        try:
            diff = difference(spark, name, fn, oracle[name], sf)
        except Exception as error:
            diff = f"{type(error).__name__}: {str(error)[:900]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - at:.2f}s{'' if diff is None else ' ' + diff}", flush=True)
    print("failed:", bad)
