"""Cohort profiling: counts, percentages, cross-tabulations, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.numbers import col, ratio
from cohortlens.sources.schema import DEMOGRAPHIC_NAMES


def shape(df: DataFrame) -> DataFrame:
    """One row: ``n_rows``, ``n_columns``, ``column_names``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Every different value, a missing one included."""
    return df.select(col(column)).distinct()


def n_distinct(df: DataFrame, column: str, out: str = "n_distinct") -> DataFrame:
    """Count of different non-missing values, by two partial aggregations."""
    return df.agg(F.count_distinct(col(column)).alias(out))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-missing value, most frequent first, ties by value."""
    return _counts(df, column).orderBy(F.desc("n"), col(column))


def _counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("n"))


def value_percentages(df: DataFrame, column: str, denominator: str = "non_null") -> DataFrame:
    """Share of every value in percent, of the non-missing values or of all rows.

    The total is a scalar subquery, so a column with very many values never meets in one
    window task.
    """
    if denominator == "non_null":
        whole = df.agg(F.count(col(column)))
    elif denominator == "rows":
        whole = df.agg(F.count(F.lit(1)))
    else:
        raise ValueError("denominator is 'non_null' or 'rows'")
    return _counts(df, column).withColumn("pct", 100.0 * ratio(F.col("n"), whole.scalar()))


def demographic_columns(df: DataFrame, names: Sequence[str] = DEMOGRAPHIC_NAMES, most: int = 10) -> DataFrame:
    """Demographic columns with 2..``most`` different values, with that number."""
    candidates = [c for c in df.columns if c.lower() in names]
    if not candidates:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct long")
    counted = df.agg(*[F.count_distinct(col(c)).alias(f"c{i}") for i, c in enumerate(candidates)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_distinct")) for i, c in enumerate(candidates)])
    return counted.select(F.inline(pairs)).filter(F.col("n_distinct").between(2, most))


def crosstab_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long cross-tab ``(a, b, n)`` of the pairs that occur."""
    return (
        df.filter(col(a).isNotNull() & col(b).isNotNull())
        .groupBy(col(a), col(b))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[str] | None = None) -> DataFrame:
    """Wide cross-tab: a row per value of ``a``, a column per value of ``b``, zeros filled."""
    long = crosstab_counts(df, a, b)
    return long.groupBy(col(a)).pivot(b, list(values) if values else None).agg(F.sum("n")).na.fill(0)


def crosstab_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long cross-tab ``(a, b, n, pct)``: percent within each value of ``b``, whatever their number."""
    long = crosstab_counts(df, a, b)
    # The window is over counted pairs, one row per (a, b).
    return long.withColumn("pct", 100.0 * ratio(F.col("n"), F.sum("n").over(Window.partitionBy(col(b)))))


def crosstab_pct(df: DataFrame, a: str, b: str, values: Sequence[str] | None = None) -> DataFrame:
    """Wide cross-tab in percent within each value of ``b`` (each column sums to 100)."""
    shares = crosstab_share(df, a, b)
    return shares.groupBy(col(a)).pivot(b, list(values) if values else None).agg(F.sum("pct")).na.fill(0.0)


def stage_column(df: DataFrame, most: int = 5) -> str | None:
    """First column named like a stage, if it is text or has at most ``most`` values."""
    named = [f for f in df.schema.fields if "stage" in f.name.lower()]
    if not named:
        return None
    first = named[0]
    if isinstance(first.dataType, T.StringType) or n_distinct(df, first.name).first()[0] <= most:
        return first.name
    return None


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column: ``(column_name, n_missing)``, one scan."""
    counted = df.agg(*[F.count_if(_is_missing(df, c)).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_missing")) for i, c in enumerate(columns)])
    return counted.select(F.inline(pairs))


def class_summary(df: DataFrame, columns: Sequence[str], by: str = "Condition") -> DataFrame:
    """Per class, in one scan: rows, rows without a missing value, and per column the smallest value
    and the number of missing ones (arrays in the order of ``columns``)."""
    missing = [_is_missing(df, c) for c in columns]
    complete = F.lit(True)
    for m in missing:
        complete = complete & ~m
    return df.groupBy(col(by)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(complete).alias("n_complete"),
        F.array(*[F.min(F.when(~m, col(c))) for c, m in zip(columns, missing)]).alias("lowest"),
        F.array(*[F.count_if(m) for m in missing]).alias("n_missing"),
    )


def removal_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, rows with any missing value in ``columns``, their share, rows kept."""
    missing = [_is_missing(df, c) for c in columns]
    any_missing = F.lit(False)
    for m in missing:
        any_missing = any_missing | m
    cells = sum((m.cast("long") for m in missing), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(any_missing).alias("n_removed"),
        F.coalesce(F.sum(cells), F.lit(0)).alias("n_missing_cells"),
    ).select(
        "n_rows",
        "n_removed",
        "n_missing_cells",
        (F.col("n_rows") - F.col("n_removed")).alias("n_kept"),
        (100.0 * ratio(F.col("n_removed"), F.col("n_rows"))).alias("pct_removed"),
    )


def _is_missing(df: DataFrame, column: str):
    value = col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()
