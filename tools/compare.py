"""Run queries in Spark and in DuckDB on the same tables and compare the rows.

Usage: python tools/compare.py FOLDER [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day).isoformat()
    return value


def sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=sort_key)


def compare(spark, con, name, run, sql, folder) -> str | None:
    """A description of the first difference, or None."""
    df = run(spark, folder)
    mine = rows_of(df.collect(), df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(cur.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = [(d[0], spark_types[d[0]], str(d[1])) for d in cur.description if kinds.get(spark_types[d[0]]) != str(d[1])]
    if odd:
        return f"types differ: {odd}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    from habitatq.catalog import oracle
    from habitatq.catalog import queries as catalog

    folder, only = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    sqls = oracle.statements()
    for name, run in catalog.as_callables().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            diff = compare(spark, con, name, run, sqls[name], folder) if name in sqls else "no SQL"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        failed += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
