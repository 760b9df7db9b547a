"""Scoring new samples with a saved bundle.

Without batch-fitted fills nothing here runs a job, so the same functions accept a
streaming frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import vectors
from cohortlens.functions.numbers import col
from cohortlens.operators import clean, joint, models, scale
from cohortlens.sources.bundle import ModelBundle
from cohortlens.sources.schema import require_columns

SCORE_FUNCTIONS = {
    "binary": models.score_binary,
    "type": models.score_boosted_multi,
    "latent": models.score_latent,
    "joint": joint.score,
}
# Kinds that score classes of either task and hold an embedding.
LATENT = ("latent", "joint")


def _ready(df: DataFrame, bundle: ModelBundle, missing: str, apply_log2: bool) -> DataFrame:
    """Checked, cleaned, filled and scaled rows with their feature vector."""
    features = bundle.preprocessing.features
    require_columns(df.columns, features)
    cleaned = clean.clean_numeric(df, features)
    if missing == "training":
        fills = None
    elif missing == "batch":
        fills = scale.fit_medians(cleaned, features)
    elif missing == "cells":
        fills = dict.fromkeys(features, scale.median_of_cells(cleaned, features))
    else:
        raise ValueError("missing is 'training', 'batch' or 'cells'")
    counted = bundle.preprocessing.count_clamped(cleaned) if apply_log2 else cleaned.withColumn("n_clamped", F.lit(0))
    scaled = bundle.preprocessing.transform_filled(counted, fills, apply_log2)
    return clean.assemble(scaled, features)


def _require_kind(bundle: ModelBundle, wanted: bool, what: str) -> None:
    if not wanted:
        raise ValueError(f"a {bundle.kind} bundle with {len(bundle.classes)} classes cannot {what}")


def _ids(df: DataFrame, bundle: ModelBundle) -> list[str]:
    return [c for c in df.columns if c not in bundle.preprocessing.features]


def score_risk(df: DataFrame, bundle: ModelBundle, missing: str = "training", apply_log2: bool = True) -> DataFrame:
    """Id columns plus ``prediction``, ``cancer_probability``, ``predicted_class`` and ``n_clamped``.

    Missing values take the training median, or on request the median of the new batch. Values
    below the training range count as its lowest value; ``n_clamped`` tells how many did.
    """
    binary = bundle.kind == "binary" or bundle.kind in LATENT and len(bundle.classes) == 2
    _require_kind(bundle, binary, "score a risk")
    scored = SCORE_FUNCTIONS[bundle.kind](bundle.model, _ready(df, bundle, missing, apply_log2))
    return scored.select(
        *[col(c) for c in _ids(df, bundle)],
        "prediction",
        F.col("score").alias("cancer_probability"),
        clean.class_name(F.col("prediction")).alias("predicted_class"),
        "n_clamped",
    )


def score_types(
    df: DataFrame,
    bundle: ModelBundle,
    top_k: int = 2,
    missing: str = "training",
    apply_log2: bool = True,
    with_embedding: bool = False,
) -> DataFrame:
    """Id columns plus the best ``top_k`` classes and their probabilities, best first.

    ``missing='cells'`` fills with the median over all values of the batch together. ``n_clamped``
    counts the values of a row below the training range, which count as its lowest value.
    """
    _require_kind(bundle, bundle.kind in ("type", *LATENT), "rank types")
    _require_kind(bundle, bundle.kind in LATENT or not with_embedding, "give an embedding")
    scored = SCORE_FUNCTIONS[bundle.kind](bundle.model, _ready(df, bundle, missing, apply_log2))
    classes = F.array(*[F.lit(c) for c in bundle.classes])
    ranked = scored.withColumn("_top", vectors.top_k(F.col("probs"), top_k))
    outputs = [
        vectors.gather(classes, F.col("_top")).alias("top_labels"),
        vectors.gather(F.col("probs"), F.col("_top")).alias("top_probabilities"),
    ]
    outputs.append(F.col("n_clamped"))
    if with_embedding:
        outputs.append(F.col("z").alias("embedding"))
    return ranked.select(*[col(c) for c in _ids(df, bundle)], *outputs)
