"""Projection, cleaning and labelling of the sample table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.numbers import col, number_in_text_sql, present_sql, quoted
from cohortlens.sources.schema import ASSAY_COLUMNS, ID_COLUMNS


def clean_numeric(df: DataFrame, columns: Sequence[str] | None = None, passthrough: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Text columns become doubles with every ``*`` removed; unreadable values become NULL.

    ``columns`` limits the work to what is used later so the scan can be pruned; without
    it every column outside ``passthrough`` is cleaned. Floating columns keep their values
    but NaN becomes NULL.
    """
    wanted = set(df.columns if columns is None else columns) - set(passthrough)
    return df.selectExpr(*[f"{_cleaned(f)} AS {quoted(f.name)}" if f.name in wanted else quoted(f.name) for f in df.schema])


def _cleaned(field: T.StructField) -> str:
    if isinstance(field.dataType, T.StringType):
        return number_in_text_sql(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return present_sql(field.name)
    return quoted(field.name)


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows whose every listed column is present (neither NULL nor NaN)."""
    return df.na.drop(how="any", subset=[quoted(c) for c in columns])


def binary_label(df: DataFrame, column: str = "Condition", normal: str = "Normal", out: str = "binary_condition") -> DataFrame:
    """0 for the normal class, 1 for every other value, a missing one included."""
    return df.withColumn(out, F.when(col(column).eqNullSafe(F.lit(normal)), 0).otherwise(1))


def exclude_class(df: DataFrame, column: str = "Condition", value: str = "Normal") -> DataFrame:
    """Rows of every other class; rows without a class stay."""
    return df.filter(~col(column).eqNullSafe(F.lit(value)))


def class_name(prediction: Column, positive: str = "Cancer", negative: str = "Normal") -> Column:
    return F.when(prediction == 1, positive).otherwise(negative)


def feature_columns(columns: Sequence[str], use_age: bool = False, assays: Sequence[str] = ASSAY_COLUMNS) -> list[str]:
    """Feature names in model order: known assays, then mutation scores, then age if asked."""
    present = set(columns)
    names = [a for a in assays if a in present]
    names += [c for c in columns if "Omega" in c and c not in names]
    if use_age and "Age" in present:
        names.append("Age")
    return names


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """One dense vector per sample; a missing value is an error, not a silent NaN."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def feature_array(features: Sequence[str]) -> Column:
    return F.array(*[col(c).cast("double") for c in features])


def fit_label_codes(df: DataFrame, column: str) -> StringIndexerModel:
    """Codes 0..k-1 in sorted label order; unknown or missing labels are refused."""
    return StringIndexer(
        inputCol=column, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error"
    ).fit(df)


def label_codes(labels: Sequence[str], column: str) -> StringIndexerModel:
    """As ``fit_label_codes`` for labels that are known already."""
    return StringIndexerModel.from_labels(sorted(labels), inputCol=column, outputCol="label", handleInvalid="error")


def encode_labels(df: DataFrame, codes: StringIndexerModel, out: str = "label") -> DataFrame:
    coded = codes.copy({codes.outputCol: "_code"}).transform(df)
    return coded.withColumn(out, F.col("_code").cast("int")).drop("_code")


def decode_labels(df: DataFrame, column: str, classes: Sequence[str], out: str) -> DataFrame:
    ready = df.withColumn("_code", col(column).cast("double"))
    return IndexToString(inputCol="_code", outputCol=out, labels=list(classes)).transform(ready).drop("_code")
