"""Top features overall, per class, and the sample that shows a feature best."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.numbers import col

# Report sizes.
TOP_FEATURES = 20
TOP_PER_CLASS = 10
CLASSES_SHOWN = 5
WATERFALL_FEATURES = 10


def top_n_features(df: DataFrame, n: int = TOP_FEATURES, value: str = "importance", name: str = "feature") -> DataFrame:
    """The ``n`` largest, best first, ties by name."""
    return df.orderBy(F.desc(value), col(name)).limit(n)


def top_n_per_group(
    df: DataFrame, group: str, n: int = TOP_PER_CLASS, value: str = "importance", name: str = "feature"
) -> DataFrame:
    """The ``n`` largest of every group with their ``rank``; each task trims before the shuffle."""
    order = Window.partitionBy(col(group)).orderBy(F.desc(value), col(name))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def first_classes(df: DataFrame, column: str = "class", n: int = CLASSES_SHOWN) -> DataFrame:
    return df.filter(col(column) < n)


def argmax_row_per_feature(attributions: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Per feature the sample with the largest absolute attribution, the lowest id on ties."""
    kept = attributions if features is None else attributions.filter(F.col("feature").isin(list(features)))
    size = F.abs(F.col("phi"))
    return kept.groupBy("feature").agg(
        F.max_by("row_id", F.struct(size, -F.col("row_id"))).alias("row_id"), F.max(size).alias("abs_phi")
    )
