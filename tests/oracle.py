"""Compare queries with their SQL: python -m tests.oracle [--dir DIR] [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder: str, name: str, con=None) -> str:
    """Empty if query and SQL agree, else what differs."""
    df = entry.queries()[name](spark, folder)
    ours = rows_of(df.columns, df.collect())
    result = (con or connect(folder)).execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if ours == theirs:
        return ""
    a, b = set(ours), set(theirs)
    return f"{len(ours)} and {len(theirs)} rows; only ours {list(a - b)[:3]}, only SQL {list(b - a)[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--dir"]:
        folder, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sql = entry.oracle_sql()
    for name in args or entry.queries():
        began = time.time()
        try:
            said = compare(spark, folder, name) if name in sql else f"rows {entry.queries()[name](spark, folder).count()} (no SQL)"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:1500]}"
        print(f"{name}: {said or 'ok'} [{time.time() - began:.1f} s]", flush=True)
