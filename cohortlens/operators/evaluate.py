"""Metrics over pooled out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import vectors
from cohortlens.functions.numbers import col, ratio_or_zero

# Multipliers of the standard error, and the display order of classes.
ONE_STANDARD_ERROR = 1.0
NINETY_FIVE_PERCENT = 1.96
CLASS_ORDER = ("Colorectum", "Ovary", "Pancreas", "Breast", "Upper GI", "Lung", "Liver")


def pool_oof(scored_folds: Sequence[DataFrame]) -> DataFrame:
    """Held-out rows of all folds in one table."""
    return reduce(lambda a, b: a.unionByName(b), scored_folds)


def attach_predictions(df: DataFrame, oof: DataFrame, key: str = "row_id") -> DataFrame:
    """Sample rows with their prediction, matched by key and never by position."""
    extra = [c for c in oof.columns if c == key or c not in df.columns]
    return df.join(oof.select(*[col(c) for c in extra]), key)


def accuracy_by_fold(oof: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = (col(prediction) == col(label)).cast("double")
    return oof.groupBy("fold").agg(F.avg(hit).alias("accuracy"))


def mean_std(df: DataFrame, column: str) -> DataFrame:
    """One row: mean and population standard deviation."""
    return df.agg(F.avg(col(column)).alias("mean"), F.stddev_pop(col(column)).alias("std"))


def best_fold(accuracies: DataFrame) -> DataFrame:
    """Fold with the highest accuracy, the first one on ties."""
    return accuracies.orderBy(F.desc("accuracy"), "fold").limit(1)


def standard_error(rate: Column, n: Column, z: float) -> Column:
    return F.lit(z) * F.sqrt(ratio_or_zero(rate * (1.0 - rate), n))


def sensitivity_by(
    oof: DataFrame, group: str, called: str = "called", label: str = "label", z: float = ONE_STANDARD_ERROR
) -> DataFrame:
    """Detected share of the true positives per group, with its error.

    ``called`` may come from a per-fold threshold, the pooled threshold or the plain
    prediction; use one standard error for stages and 1.96 for classes.
    """
    positives = oof.filter((col(label) == 1) & col(group).isNotNull())
    counted = positives.groupBy(col(group)).agg(
        F.count_if(col(called) == 1).alias("detected"), F.count(F.lit(1)).alias("total")
    )
    rated = counted.withColumn("sensitivity", ratio_or_zero(F.col("detected"), F.col("total")))
    return rated.withColumn("error", standard_error(F.col("sensitivity"), F.col("total"), z))


def confusion_counts(oof: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)`` of the pairs that occur."""
    return oof.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(oof: DataFrame, classes: Sequence, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A row per true class and a column per predicted class, all classes present."""
    counts = confusion_counts(oof, label, prediction)
    cells = [F.sum(F.when(F.col("prediction") == c, F.col("n")).otherwise(0)).alias(str(c)) for c in classes]
    wide = counts.groupBy("label").agg(*cells)
    rows = oof.sparkSession.createDataFrame([(c,) for c in classes], f"label {oof.schema[label].dataType.simpleString()}")
    return rows.join(wide, "label", "left").na.fill(0, [str(c) for c in classes])


def confusion_cells(oof: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: the four cells of a binary task."""
    truth, guess = col(label) == 1, col(prediction) == 1
    return oof.agg(
        F.count_if(~truth & ~guess).alias("true_negative"),
        F.count_if(~truth & guess).alias("false_positive"),
        F.count_if(truth & ~guess).alias("false_negative"),
        F.count_if(truth & guess).alias("true_positive"),
    )


def classification_report(oof: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    Columns ``(class, precision, recall, f1, support)``; a zero division counts as 0, and
    the accuracy row repeats the accuracy in all three rates. All work after the first
    aggregation is on one row per (class, class) pair.
    """
    counts = confusion_counts(oof, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("c"), F.col("n").alias("true_n"), F.lit(0).cast("long").alias("pred_n"), hit.cast("long").alias("tp")),
                F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("true_n"), F.col("n").alias("pred_n"), F.lit(0).cast("long").alias("tp")),
            )
        )
    )
    totals = sides.groupBy("c").agg(F.sum("true_n").alias("support"), F.sum("pred_n").alias("pred_n"), F.sum("tp").alias("tp"))
    precision = ratio_or_zero(F.col("tp"), F.col("pred_n"))
    recall = ratio_or_zero(F.col("tp"), F.col("support"))
    per_class = totals.select(
        F.col("c").cast("string").alias("class"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio_or_zero(2.0 * precision * recall, precision + recall).alias("f1"),
        "support",
        "tp",
    )
    support = F.sum("support")
    accuracy = ratio_or_zero(F.sum("tp"), support)
    rates = ("precision", "recall", "f1")

    def summary(name: str, values: Sequence[Column]) -> Column:
        named = [v.alias(r) for r, v in zip(rates, values)]
        return F.struct(F.lit(name).alias("class"), *named, support.alias("support"))

    averages = per_class.agg(
        F.array(
            summary("accuracy", [accuracy] * 3),
            summary("macro avg", [F.avg(r) for r in rates]),
            summary("weighted avg", [ratio_or_zero(F.sum(F.col(r) * F.col("support")), support) for r in rates]),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.drop("tp").unionByName(averages)


def topk_accuracy_by_class(
    oof: DataFrame, classes: Sequence[str], label: str = "label", prediction: str = "prediction", probs: str = "probs"
) -> DataFrame:
    """Per class: rows, top-1 and top-2 accuracy, and the 95% error of top-2; zeros if empty."""
    counted = oof.groupBy(col(label).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(col(prediction) == col(label)).alias("top1_correct"),
        F.count_if(vectors.in_top_k(col(label), col(probs), 2)).alias("top2_correct"),
    )
    names = oof.sparkSession.createDataFrame(list(enumerate(classes)), "label int, class string")
    filled = names.join(counted, "label", "left").na.fill(0, ["total", "top1_correct", "top2_correct"])
    rated = filled.withColumn("top1", ratio_or_zero(F.col("top1_correct"), F.col("total"))).withColumn(
        "top2", ratio_or_zero(F.col("top2_correct"), F.col("total"))
    )
    return rated.withColumn("error", standard_error(F.col("top2"), F.col("total"), NINETY_FIVE_PERCENT))


def class_position(name: Column, order: Sequence[str] = CLASS_ORDER) -> Column:
    """Place in a fixed display order, case ignored; NULL for names outside it."""
    spot = F.array_position(F.array(*[F.lit(o.lower()) for o in order]), F.lower(name))
    return F.when(spot > 0, spot.cast("int") - 1)


def custom_order(df: DataFrame, column: str, order: Sequence[str] = CLASS_ORDER) -> DataFrame:
    """Rows of a report in display order, unknown classes last by name."""
    return df.orderBy(class_position(col(column), order).asc_nulls_last(), col(column))


def topk_stack(by_class: DataFrame, order: Sequence[str] = CLASS_ORDER) -> DataFrame:
    """Stacked-bar rows in percent: top-1, what top-2 adds, and the error, in display order."""
    bars = by_class.select(
        "class",
        (100.0 * F.col("top1")).alias("top1_pct"),
        (100.0 * (F.col("top2") - F.col("top1"))).alias("top2_only_pct"),
        (100.0 * F.col("error")).alias("error_pct"),
    )
    return custom_order(bars, "class", order)
