"""Compare named queries with their SQL text run by DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

# Digits compared; a large number means bit for bit.
DIGITS = int(os.environ.get("ORACLE_DIGITS", "9"))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, DIGITS)
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql):
    cursor = con.execute(sql)
    return table([d[0] for d in cursor.description], cursor.fetchall())


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), []
    for name in wanted:
        start = time.time()
        try:
            got = spark_table(entry.queries()[name](spark, sf_dir))
            spent = time.time() - start
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"rows-only {name} {len(got[1])} {spent:.1f}s", flush=True)
                continue
            want = sql_table(con, sql)
            same = got == want
            print(f"{'ok  ' if same else 'DIFF'} {name} {len(got[1])} rows {spent:.1f}s", flush=True)
            if not same:
                bad.append(name)
                print("  columns", got[0], want[0] if got[0] != want[0] else "")
                extra = [r for r in got[1] if r not in set(want[1])][:3]
                missing = [r for r in want[1] if r not in set(got[1])][:3]
                print("  rows", len(got[1]), len(want[1]), "\n   spark", extra, "\n   sql", missing)
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name} {str(error)[:600]}", flush=True)
    print(len(wanted) - len(bad), "of", len(wanted), "bad:", bad)
