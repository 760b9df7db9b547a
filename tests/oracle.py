"""Runs a bound query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


SQL_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def sql_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return sql_type(spark_type[6:-1]) + "[]"
    return SQL_NAMES.get(spark_type, spark_type)


def compare(spark, con, fn, sql, sf_dir: str) -> str | None:
    """None when names, types and rows are equal, else a short description."""
    df = fn(spark, sf_dir)
    result = con.execute(sql)
    left_types = sorted((n, sql_type(t)) for n, t in df.dtypes)
    right_types = sorted((d[0], str(d[1])) for d in result.description)
    if left_types != right_types:
        return f"schemas differ: {sorted(set(left_types) ^ set(right_types))}"
    names = [d[0] for d in result.description]
    _, right = rows_of(names, result.fetchall())
    _, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else None
