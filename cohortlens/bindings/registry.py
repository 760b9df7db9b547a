"""Registry of bound queries and small helpers they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.numbers import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a bound query; without SQL it is checked for rows only."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Six decimals: engines differ in the last bits of log2, exp and sums."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def rounded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[r6(col(c)).alias(c) if c in columns else col(c) for c in df.columns])


def rounded_array(values: Column) -> Column:
    return F.transform(values, lambda v: F.round(v, 6))
