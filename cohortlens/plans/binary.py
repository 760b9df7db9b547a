"""Normal against cancer with boosted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens.functions.numbers import col
from cohortlens.operators import curves, evaluate, folds, models, profile
from cohortlens.operators.report import metrics_table, section
from cohortlens.plans.common import Cohort, Study, accuracy_tables, cohort_facts, prepare_cohort, validate
from cohortlens.sources.bundle import ModelBundle
from cohortlens.sources.staging import stage, staged_paths


def sensitivity_tables(
    oof: DataFrame, threshold: str, per_fold: DataFrame | None = None, pooled: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Sensitivity by stage (one standard error) and by class (95%).

    ``threshold``: ``fold`` (each fold at its own operating point, ``per_fold``), ``pooled`` (one
    point over all folds, ``pooled``) or ``argmax`` (the plain prediction).
    """
    if threshold == "argmax":
        hits = oof.withColumn("called", oof["prediction"])
    elif threshold == "fold":
        hits = curves.apply_threshold(oof, per_fold, ["fold"])
    elif threshold == "pooled":
        hits = curves.apply_threshold(oof, pooled)
    else:
        raise ValueError("threshold is 'fold', 'pooled' or 'argmax'")
    tables = {"sensitivity_by_class": evaluate.sensitivity_by(hits, "Condition", z=evaluate.NINETY_FIVE_PERCENT)}
    if "Stage" in oof.columns:
        tables["sensitivity_by_stage"] = evaluate.sensitivity_by(hits, "Stage")
    return tables


def binary_tables(oof: DataFrame, threshold: str) -> dict[str, DataFrame]:
    """All reports of a scored binary cohort: accuracy, curve, operating points, cells.

    The running counts are worked out twice, per fold and pooled, and staged; areas, curves and
    operating points are read from those.
    """
    fold_ladder = stage(curves.score_ladder(oof, by=["fold"]), "fold-ladder")
    ladder = stage(curves.score_ladder(oof), "ladder")
    per_fold_auc = curves.auc_of_ladder(fold_ladder, ["fold"])
    per_fold_points = curves.threshold_at_specificity(curves.curve_points(fold_ladder, ["fold"]), ["fold"])
    points = curves.curve_points(ladder)
    pooled_point = curves.threshold_at_specificity(points)
    return {
        **accuracy_tables(oof),
        "auc_by_fold": per_fold_auc,
        "auc_mean": evaluate.mean_std(per_fold_auc, "auc"),
        "auc": curves.auc_of_ladder(ladder),
        "roc_curve": points,
        "operating_point": pooled_point,
        "operating_point_by_fold": per_fold_points,
        "classification_report": evaluate.classification_report(oof),
        "confusion_cells": evaluate.confusion_cells(oof),
        "confusion_matrix": evaluate.confusion_matrix(oof, [0, 1]),
        **sensitivity_tables(oof, threshold, per_fold_points, pooled_point),
    }


def binary_summary(cohort: Cohort, tables: dict[str, DataFrame], **settings: float) -> DataFrame:
    spark = cohort.table.sparkSession
    parts = [
        cohort_facts(spark, cohort, **settings),
        section(tables["accuracy_by_fold"], "fold accuracy", "fold", "accuracy"),
        tables["accuracy"].transform(_one, "accuracy", "mean", "std"),
        tables["auc"].transform(_one, "auc", "auc"),
        tables["auc_mean"].transform(_one, "auc by fold", "mean", "std"),
        section(tables["sensitivity_by_class"], "sensitivity by class", "Condition", "sensitivity", "error"),
        tables["confusion_cells"].transform(
            _one, "confusion", "true_negative", "false_positive", "false_negative", "true_positive"
        ),
        section(tables["classification_report"], "report", "class", "precision", "recall", "f1", "support"),
    ]
    if "sensitivity_by_stage" in tables:
        parts.append(section(tables["sensitivity_by_stage"], "sensitivity by stage", "Stage", "sensitivity", "error"))
    return metrics_table(*parts)


def _one(df: DataFrame, name: str, *values: str) -> DataFrame:
    from pyspark.sql import functions as F

    return section(df, name, F.lit("all"), *values)


def run_binary(
    samples: DataFrame,
    k: int = folds.BINARY_FOLDS,
    rounds: int = models.BOOST_ROUNDS,
    threshold: str = "fold",
    fit_scope: str = "all",
    parallelism: int = 2,
    bundle: bool = True,
) -> Study:
    """Cross-validate boosted trees, report at the high-specificity point, refit on all rows.

    ``bundle=False`` leaves out the medians that only scoring new samples needs.
    """
    spark = samples.sparkSession
    with staged_paths() as staged:
        cohort = prepare_cohort(samples, "binary", k, fit_scope=fit_scope, with_medians=bundle)
        weight = folds.positive_weight(cohort.table).first()["pos_weight"]

        def fit(train: DataFrame):
            return models.fit_boosted_binary(train, weight, rounds)

        fitted = None
        if fit_scope == "all":
            *fitted, final = models.fit_binary_folds(cohort.rows.coalesce(cohort.fit_tasks), k, weight, rounds)
        else:
            final = fit(cohort.rows.coalesce(cohort.fit_tasks))
        cv = validate(cohort, fit, models.score_binary, ["row_id", "Condition", "Stage"], parallelism, fitted)
        fold_models = [m if fit_scope == "all" else m[1] for m in cv.models]
        tables = {
            "oof": cv.oof,
            **binary_tables(cv.oof, threshold),
            **cohort.quality_tables(),
            "class_distribution": profile.value_percentages(samples, "Condition", "rows"),
            "importance": models.feature_importance(spark, final, cohort.features),
            "mean_importance": models.mean_importance(
                [models.feature_importance(spark, m, cohort.features) for m in fold_models]
            ),
            "preprocessed": cohort.scaled.withColumn("binary_condition", col("label")),
        }
        tables["summary"] = binary_summary(cohort, tables, folds=k, rounds=rounds)
    return Study(tables, ModelBundle("binary", final, cohort.preprocessing, cohort.classes), cv.models, staged)
