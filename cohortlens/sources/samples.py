"""Reading the wide sample table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortlens.operators.clean import exclude_class
from cohortlens.sources.schema import require_columns


def read_samples(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    required: Sequence[str] = ("Condition",),
    fallback: str | Sequence[str] | None = None,
    exclude: str = "Normal",
) -> DataFrame:
    """The sample table, or ``fallback`` without its ``exclude`` class if ``path`` is absent.

    Both may be one path or several that are read as one table.

    CSV needs an explicit schema (assay values as text), so no pass is spent on inference.
    """
    if fmt == "csv" and schema is None:
        raise ValueError("a CSV sample table needs a schema")
    try:
        samples = _open(spark, path, schema, fmt)
    except AnalysisException as error:
        if fallback is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        samples = exclude_class(_open(spark, fallback, schema, fmt), "Condition", exclude)
    require_columns(samples.columns, required)
    return samples


def _open(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None, fmt: str) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path if isinstance(path, str) else list(path))
