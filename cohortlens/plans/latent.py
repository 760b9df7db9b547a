"""Latent model with a class head, for the binary task and for cancer types."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import vectors
from cohortlens.operators import clean, coalitions, evaluate, explain, folds, joint, latent, models, neighbours, profile, ranking
from cohortlens.plans.binary import binary_summary, binary_tables, sensitivity_tables
from cohortlens.plans.common import Cohort, Study, prepare_cohort, validate
from cohortlens.plans.types import type_summary, type_tables
from cohortlens.sources.bundle import ModelBundle
from cohortlens.sources.staging import stage, staged_paths

BACKGROUND_SEED, EXPLAINED_SEED = 42, 43


def explain_model(
    cohort: Cohort,
    model: PipelineModel | joint.JointModel,
    background_rows: int = explain.BACKGROUND_ROWS,
    explained_rows: int | None = explain.EXPLAINED_ROWS,
    attribution: str = "orders",
) -> dict[str, DataFrame]:
    """Attribution tables of a latent model's class head on a sample of the cohort.

    ``explained_rows=None`` explains every row; the default is the study's budget. ``attribution``
    is by sampled feature ``orders`` or by ``kernel`` regression over coalitions.
    """
    binary = len(cohort.classes) == 2 and cohort.classes[0] == "Normal"

    def score(df: DataFrame) -> DataFrame:
        if isinstance(model, joint.JointModel):
            scored = df.withColumn("_out", model.outputs(F.col("x"))).withColumn("probability", vectors.softmax(F.col("_out.logits"))).drop("_out")
            probs = F.col("probability")
        else:
            scored = model.stages[1].transform(df.withColumn("features", array_to_vector("x")))
            probs = vector_to_array(F.col("probability"))
        return scored.withColumn("scores", F.array(vectors.element(probs, 1)) if binary else probs)

    background = folds.sample_n(cohort.scaled, background_rows, "row_id", BACKGROUND_SEED)
    rows = cohort.scaled if explained_rows is None else folds.sample_n(cohort.scaled, explained_rows, "row_id", EXPLAINED_SEED)
    attribute = {"orders": explain.shapley_attributions, "kernel": coalitions.kernel_attributions}[attribution]
    phi = stage(attribute(rows, cohort.features, score, background), "attributions")
    ranked = explain.shap_ranking(phi)
    shown = [r["feature"] for r in ranked.limit(explain.TOP_SHOWN).collect()]
    tables = {
        "attributions": phi,
        "shap_ranking": ranked,
        "top_features": ranking.top_n_features(ranked),
        "dependence": explain.dependence_rows(phi, shown),
    }
    if binary:
        best = ranking.argmax_row_per_feature(phi, shown)
        tables["waterfall_samples"] = best
        for row in best.collect():
            tables[f"waterfall {row['feature']}"] = explain.waterfall_rows(phi, row["row_id"])
    else:
        per_class = explain.class_shap_ranking(phi)
        tables["class_shap_ranking"] = ranking.top_n_per_group(ranking.first_classes(per_class), "class")
    return tables


def _fit_joint(cohort: Cohort, task: str, dimension: int, epochs: int) -> tuple[list | None, joint.JointModel, models.Fit]:
    """Fold models (None if each fold has its own scale), the model of all rows, and how a fold is fitted alone.

    Types weigh the class loss more in cross-validation than in the final fit, as the study does;
    where both weights are equal all models learn in one pass.
    """
    final = joint.Joint(len(cohort.features), len(cohort.classes), dimension, epochs=epochs)
    ours = final if task == "binary" else replace(final, lambda_class=latent.LAMBDA_CLASS_TYPE_FOLDS)
    rows = cohort.rows.coalesce(cohort.fit_tasks)

    def alone(train: DataFrame) -> joint.JointModel:
        return joint.fit(train, ours, key="row_id")[0]

    if cohort.fit_scope != "all":
        return None, joint.fit(rows, final, key="row_id")[0], alone
    if ours == final:
        *fitted, whole = joint.fit(rows, final, [*range(cohort.k), None], key="row_id")
        return fitted, whole, alone
    return joint.fit(rows, ours, range(cohort.k), key="row_id"), joint.fit(rows, final, key="row_id")[0], alone


def run_latent(
    samples: DataFrame,
    task: str = "binary",
    k: int = folds.BINARY_FOLDS,
    iterations: int = models.HEAD_ITERATIONS,
    fit_scope: str = "all",
    parallelism: int = 2,
    background_rows: int = explain.BACKGROUND_ROWS,
    explained_rows: int | None = explain.EXPLAINED_ROWS,
    bundle: bool = True,
    model: str = "linear",
    attribution: str = "orders",
    layout: str = "linear",
) -> Study:
    """Cross-validate embedding and class head, report, explain the best fold, refit.

    ``model`` is ``linear`` (linear embedding beside a neural class head) or ``joint`` (encoder,
    decoder and class head under one loss; ``iterations`` are its epochs and ``loss_curves`` its four
    losses); ``attribution`` is ``orders`` or ``kernel``; ``layout`` of the map is ``linear`` or ``neighbours``.
    """
    if model not in ("linear", "joint") or attribution not in ("orders", "kernel") or layout not in ("linear", "neighbours"):
        raise ValueError("model is 'linear' or 'joint', attribution 'orders' or 'kernel', layout 'linear' or 'neighbours'")
    source = samples if task == "binary" else clean.exclude_class(samples)
    with staged_paths() as staged:
        cohort = prepare_cohort(source, task, k, fit_scope=fit_scope, with_medians=bundle)
        n_features, n_classes = len(cohort.features), len(cohort.classes)
        dimension = min(models.LATENT_DIM, n_features)

        def fit(train: DataFrame):
            return models.fit_latent(train, n_features, n_classes, dimension, iterations=iterations)

        score, fitted = models.score_latent, None
        if model == "joint":
            fitted, final, fit = _fit_joint(cohort, task, dimension, iterations)
            score = joint.score
        cv = validate(cohort, fit, score, ["row_id", "PatientID", "Condition", "Stage"], parallelism, fitted)
        fold_models = [m if fit_scope == "all" else m[1] for m in cv.models]
        if model == "linear":
            final = fit(cohort.rows.coalesce(cohort.fit_tasks))
        tables = {"oof": cv.oof, **cohort.quality_tables()}
        tables["class_distribution"] = profile.value_percentages(source, "Condition", "rows")
        if task == "binary":
            tables["preprocessed"] = cohort.scaled.withColumn("binary_condition", F.col("label"))
            tables |= binary_tables(cv.oof, "pooled")
            tables |= {f"{n}_argmax": t for n, t in sensitivity_tables(cv.oof, "argmax").items()}
        else:
            tables["preprocessed"] = cohort.scaled
            tables |= type_tables(cv.oof, cohort.classes)
            tables["fold_class_distribution"] = folds.fold_class_distribution(cohort.table, k=k)
        tables["latent_map"] = {"linear": models.project_2d, "neighbours": neighbours.neighbour_map}[layout](cv.oof.select("row_id", "label", "z"))
        if model == "joint":
            tables["loss_curves"] = joint.loss_curves(samples.sparkSession, fold_models)
            tables["loss_curve"] = tables["loss_curves"].select("fold", F.col("epoch").alias("iteration"), "loss")
        else:
            tables["loss_curve"] = models.loss_curve(samples.sparkSession, [m.stages[1] for m in fold_models])
        best = evaluate.best_fold(tables["accuracy_by_fold"])
        tables["best_fold"] = best
        tables |= explain_model(cohort, fold_models[best.first()["fold"]], background_rows, explained_rows, attribution)
        settings = {"latent dimension": dimension, "beta": latent.BETA, "lambda": latent.LAMBDA_CLASS}
        summarise = binary_summary if task == "binary" else type_summary
        tables["summary"] = summarise(cohort, tables, folds=k, **settings)
    return Study(tables, ModelBundle("latent" if model == "linear" else "joint", final, cohort.preprocessing, cohort.classes), cv.models, staged)
