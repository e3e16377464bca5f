"""Run registered queries and their SQL checks side by side.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), rows_of(names, cur.fetchall())


def difference(df, con, sql):
    """None when equal, else what differs first."""
    names, ours = spark_rows(df)
    other_names, theirs = duck_rows(con, sql)
    if names != other_names:
        return f"columns {names} / {other_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} / {len(theirs)} rows"
    odd = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(odd)} rows differ, first {odd[0]}" if odd else None


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = database(sf_dir), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if len(args) > 1 and name not in args[1:]:
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                note = problem or "equal"
            else:
                problem, note = None, f"{len(df.collect())} rows, no SQL"
        except Exception as e:  # report and go on
            problem = note = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok '} {name:26s} {time.time() - began:6.1f}s {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
