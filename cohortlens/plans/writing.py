"""The files a finished study leaves behind."""

from __future__ import annotations

from cohortlens.plans.common import Study
from cohortlens.sources import sinks
from cohortlens.sources.bundle import save_bundle


def write_study(study: Study, path: str, fmt: str = "csv") -> dict[str, str]:
    """Write what later work reads of a study and return where each part lies under ``path``.

    Always ``preprocessed`` (scaled features with the class; the binary label or the patient id),
    ``oof``, ``confusion_matrix``, ``summary`` and ``bundle``; ``feature_importance`` of boosted
    binary studies, ``top_features`` of explained ones, and ``class_weights`` of weighted ones.
    """
    tables, bundle = study.tables, study.bundle
    spark = tables["oof"].sparkSession
    binary = "confusion_cells" in tables
    parts = {name: f"{path}/{name}" for name in ("preprocessed", "oof", "confusion_matrix", "summary", "bundle")}
    extra = ("Condition", "binary_condition") if binary else ("Condition", "PatientID")
    sinks.write_preprocessed(tables["preprocessed"], parts["preprocessed"], bundle.preprocessing.features, fmt, extra)
    tables["oof"].write.mode("overwrite").parquet(parts["oof"])
    sinks.write_confusion(tables["confusion_matrix"], parts["confusion_matrix"], bundle.classes)
    sinks.write_metrics(tables["summary"], parts["summary"])
    save_bundle(bundle, parts["bundle"], spark)
    if "importance" in tables:
        parts["feature_importance"] = f"{path}/feature_importance"
        sinks.write_importance(tables["importance"], parts["feature_importance"])
    if "shap_ranking" in tables:
        parts["top_features"] = f"{path}/top_features"
        sinks.write_top_features(tables["shap_ranking"], parts["top_features"])
    if "class_weights" in tables:
        parts["class_weights"] = f"{path}/class_weights"
        sinks.write_metrics(tables["class_weights"], parts["class_weights"])
    return parts
