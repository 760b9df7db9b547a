"""The run summary: one long table ``(section, key, value)``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.evaluate import pool_oof


def facts(spark: SparkSession, section: str, values: Mapping[str, float]) -> DataFrame:
    """Numbers known to the driver: shapes, settings."""
    rows = [(section, k, float(v)) for k, v in values.items()]
    return spark.createDataFrame(rows, "section string, key string, value double")


def section(df: DataFrame, name: str, key: Column | str, *values: str) -> DataFrame:
    """One summary row per row and value column; several values extend the key."""
    key_column = F.col(key) if isinstance(key, str) else key
    text = key_column.cast("string")
    cells = [
        F.struct(
            (text if len(values) == 1 else F.concat_ws(" ", text, F.lit(v))).alias("key"),
            F.col(v).cast("double").alias("value"),
        )
        for v in values
    ]
    return df.select(F.lit(name).alias("section"), F.inline(F.array(*cells)))


def metrics_table(*sections: DataFrame) -> DataFrame:
    return pool_oof(sections)
