"""Result files. Large tables are written in parallel, finished reports as one file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import col
from cohortlens.operators.ranking import TOP_FEATURES, top_n_features


def write_preprocessed(
    df: DataFrame, path: str, features: Sequence[str], fmt: str = "csv", extra: Sequence[str] = ("Condition", "binary_condition", "PatientID")
) -> None:
    """Scaled features with those of the ``extra`` columns that are present."""
    kept = [c for c in extra if c in df.columns]
    writer = df.select(*[col(c) for c in [*features, *kept]]).write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_importance(importance: DataFrame, path: str) -> None:
    """``Feature, Importance`` with the largest first."""
    ordered = importance.orderBy(F.desc("importance"), "feature")
    _write_report(ordered.select(col("feature").alias("Feature"), col("importance").alias("Importance")), path)


def write_confusion(matrix: DataFrame, path: str, classes: Sequence[str]) -> None:
    """Confusion matrix with class names on both axes; ``matrix`` is keyed by class code."""
    names = F.array(*[F.lit(c) for c in classes])
    named = matrix.orderBy("label").select(
        F.get(names, F.col("label").cast("int")).alias("class"),
        *[col(str(i)).alias(name) for i, name in enumerate(classes)],
    )
    _write_report(named, path)


def top_features_table(importance: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """Rank, feature and importance with six decimals of the ``n`` best."""
    best = top_n_features(importance, n)
    # At most n rows are left, so collecting them in one array is bounded.
    ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("k"), "feature"))).alias("rows"))
    return ranked.select(F.posexplode("rows").alias("pos", "row")).select(
        (F.col("pos") + 1).alias("Rank"),
        F.col("row.feature").alias("Feature"),
        F.format_string("%.6f", -F.col("row.k")).alias("SHAP Importance"),
    )


def write_top_features(importance: DataFrame, path: str, n: int = TOP_FEATURES) -> None:
    table = top_features_table(importance, n)
    table.coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    _write_report(metrics, path)


def _write_report(report: DataFrame, path: str) -> None:
    """One CSV file: reports have a row per class or feature, never per sample."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
