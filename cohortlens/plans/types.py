"""Cancer type with boosted trees under a softmax, plain or with balanced class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import clean, evaluate, folds, models, profile
from cohortlens.operators.report import metrics_table, section
from cohortlens.plans.common import Cohort, Study, accuracy_tables, cohort_facts, prepare_cohort, validate
from cohortlens.sources.bundle import ModelBundle
from cohortlens.sources.staging import staged_paths


def type_tables(oof: DataFrame, classes: list[str]) -> dict[str, DataFrame]:
    """All reports of a scored type cohort, with class names instead of codes."""
    by_class = evaluate.topk_accuracy_by_class(oof, classes)
    names = F.array(*[F.lit(c) for c in classes])
    named = oof.select(
        F.get(names, F.col("label")).alias("label"), F.get(names, F.col("prediction")).alias("prediction")
    )
    return {
        **accuracy_tables(oof),
        "accuracy_by_class": by_class,
        "accuracy_bars": evaluate.topk_stack(by_class),
        "classification_report": evaluate.classification_report(named),
        "confusion_matrix": evaluate.confusion_matrix(oof, list(range(len(classes)))),
    }


def type_summary(cohort: Cohort, tables: dict[str, DataFrame], **settings: float) -> DataFrame:
    return metrics_table(
        cohort_facts(cohort.table.sparkSession, cohort, **settings),
        section(tables["class_distribution"], "class distribution", "Condition", "n", "pct"),
        section(tables["accuracy_by_fold"], "fold accuracy", "fold", "accuracy"),
        section(tables["accuracy"], "accuracy", F.lit("all"), "mean", "std"),
        section(
            tables["accuracy_by_class"], "accuracy by class", "class",
            "total", "top1", "top1_correct", "top2", "top2_correct",
        ),
        section(tables["classification_report"], "report", "class", "precision", "recall", "f1", "support"),
    )


def run_type(
    samples: DataFrame,
    weighted: bool = False,
    k: int = folds.TYPE_TREE_FOLDS,
    rounds: int = models.BOOST_ROUNDS,
    fit_scope: str = "all",
    parallelism: int = 2,
    bundle: bool = True,
) -> Study:
    """Cross-validate the type model, report top-1 and top-2 accuracy, refit on all rows.

    Normal samples are left out; a sample without a type is an error, as it has no code.
    """
    cancers = clean.exclude_class(samples)
    with staged_paths() as staged:
        cohort = prepare_cohort(cancers, "type", k, fit_scope=fit_scope, with_medians=bundle)

        def fit(train: DataFrame):
            return models.fit_boosted_multi(train, weighted, rounds)

        fitted = None
        if fit_scope == "all":
            *fitted, final = models.fit_multi_folds(cohort.rows.coalesce(cohort.fit_tasks), k, weighted, rounds)
        else:
            final = fit(cohort.rows.coalesce(cohort.fit_tasks))
        cv = validate(cohort, fit, models.score_boosted_multi, ["row_id", "PatientID", "Condition"], parallelism, fitted)
        weights = folds.balanced_weights(cohort.table) if weighted else None
        tables = {
            "oof": cv.oof,
            **type_tables(cv.oof, cohort.classes),
            **cohort.quality_tables(),
            "class_distribution": profile.value_percentages(cancers, "Condition", "rows"),
            "fold_class_distribution": folds.fold_class_distribution(cohort.table, k=k),
            "preprocessed": cohort.scaled,
        }
        named = {}
        if weights is not None:
            tables["class_weights"] = weights
            named = {cohort.classes[int(r["label"])]: r["weight"] for r in weights.collect()}
        tables["summary"] = type_summary(cohort, tables, folds=k, rounds=rounds)
    return Study(tables, ModelBundle("type", final, cohort.preprocessing, cohort.classes, named), cv.models, staged)
