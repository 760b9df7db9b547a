"""Classifiers and embeddings with the study's settings: boosted trees, and Spark ML estimators.

Inputs are DataFrames with ``features`` (vector) and ``label`` (0..k-1); outputs of the
score functions are plain columns, so everything after a fit is ordinary DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import vectors
from cohortlens.functions.numbers import col
from cohortlens.operators import boosting, heads
from cohortlens.operators.evaluate import pool_oof
from cohortlens.operators.folds import SEED, test_split, train_split

# Settings of the study's models.
BOOST_ROUNDS = 100
BOOST_STEP = 0.05
BOOST_DEPTH_BINARY = 3
BOOST_DEPTH_TYPE = 4
BOOST_ROW_SHARE = 0.8
BOOST_COLUMN_SHARE = 0.8
BOOST_MIN_WEIGHT = 2.0
BOOST_GAMMA = 0.1
BOOST_L1 = 0.5
BOOST_L2 = 10.0
LATENT_DIM = 8
HIDDEN_LAYERS = (64, 32)
HEAD_ITERATIONS = 100

_DECOMPOSITION = Lock()

Fit = Callable[[DataFrame], Transformer]
Score = Callable[[Transformer, DataFrame], DataFrame]


def boost_settings(depth: int, rounds: int = BOOST_ROUNDS, seed: int = SEED) -> boosting.Boosting:
    return boosting.Boosting(
        rounds, depth, BOOST_STEP, BOOST_ROW_SHARE, BOOST_COLUMN_SHARE, BOOST_MIN_WEIGHT, BOOST_GAMMA, BOOST_L1, BOOST_L2, seed=seed
    )


# --- fits -------------------------------------------------------------------


def _key(df: DataFrame) -> str | None:
    """The column that decides which rows a tree draws, where the rows have one."""
    return "row_id" if "row_id" in df.columns else None


def fit_boosted_binary(
    df: DataFrame, pos_weight: float = 1.0, rounds: int = BOOST_ROUNDS, seed: int = SEED
) -> boosting.TreeModel:
    """Boosted trees for a 0/1 label; positives carry ``pos_weight``."""
    return boosting.fit(df, 2, boost_settings(BOOST_DEPTH_BINARY, rounds, seed), weights=[[1.0, pos_weight]], key=_key(df))[0]


def fit_boosted_multi(df: DataFrame, weighted: bool = False, rounds: int = BOOST_ROUNDS, seed: int = SEED) -> boosting.TreeModel:
    """Boosted trees for k classes under one softmax, optionally with balanced class weights."""
    return fit_multi_folds(df, 0, weighted, rounds, seed)[0]


def fit_binary_folds(
    df: DataFrame, k: int, pos_weight: float = 1.0, rounds: int = BOOST_ROUNDS, seed: int = SEED
) -> list[boosting.TreeModel]:
    """The models that leave out fold 0, 1, ... and, last, the model of all rows: one pass over the rows for all."""
    settings = boost_settings(BOOST_DEPTH_BINARY, rounds, seed)
    return boosting.fit(df, 2, settings, [*range(k), None], weights=[[1.0, pos_weight]] * (k + 1), key=_key(df))


def fit_multi_folds(
    df: DataFrame, k: int, weighted: bool = False, rounds: int = BOOST_ROUNDS, seed: int = SEED
) -> list[boosting.TreeModel]:
    """As ``fit_binary_folds`` for k classes; balanced weights are those of each model's own rows."""
    fold = F.col("fold") if k else F.lit(-1)
    counts = df.where("label is not null").groupBy(fold.alias("fold"), "label").agg(F.count(F.lit(1)).alias("n")).collect()
    n_classes = max(2, max((int(r["label"]) for r in counts), default=1) + 1)
    leave_out = [*range(k), None]
    weights = [[1.0] * n_classes for _ in leave_out]
    if weighted:
        for m, out in enumerate(leave_out):
            own = [sum(r["n"] for r in counts if r["label"] == c and r["fold"] != out) for c in range(n_classes)]
            present = sum(n > 0 for n in own)
            weights[m] = [sum(own) / (present * n) if n else 0.0 for n in own]
    return boosting.fit(df, n_classes, boost_settings(BOOST_DEPTH_TYPE, rounds, seed), leave_out, weights, key=_key(df), softmax=True)


def fit_class_head(
    df: DataFrame,
    n_features: int,
    n_classes: int,
    hidden: Sequence[int] = HIDDEN_LAYERS,
    iterations: int = HEAD_ITERATIONS,
    seed: int = SEED,
) -> Transformer:
    """Neural class head trained by distributed gradient sums."""
    return heads.fit(df, [n_features, *hidden, n_classes], iterations, seed)


def fit_embedding(df: DataFrame, k: int = LATENT_DIM, features: str = "features", out: str = "embedding") -> Transformer:
    """Low-dimensional linear embedding; input must be centred, as scaled features are.

    The covariance is summed on executors; its small decomposition runs on the driver with a
    library that fails when two threads use it first at the same time.
    """
    with _DECOMPOSITION:
        return PCA(k=k, inputCol=features, outputCol=out).fit(df)


@dataclass
class LatentFit:
    """What a fold of the latent model holds: class head and embedding together."""

    head: Transformer
    embedding: Transformer

    def as_model(self) -> PipelineModel:
        return PipelineModel(stages=[self.embedding, self.head])


def fit_latent(
    df: DataFrame, n_features: int, n_classes: int, k: int = LATENT_DIM, iterations: int = HEAD_ITERATIONS, seed: int = SEED
) -> PipelineModel:
    return LatentFit(
        fit_class_head(df, n_features, n_classes, iterations=iterations, seed=seed), fit_embedding(df, k)
    ).as_model()


# --- scores -----------------------------------------------------------------


def _carried(df: DataFrame) -> list[Column]:
    """Input columns that go along with the scores: all but the model's own inputs."""
    return [col(c) for c in df.columns if c not in ("features", "weight")]


def score_binary(model: boosting.TreeModel, df: DataFrame) -> DataFrame:
    """``score`` = probability of class 1 and ``prediction`` = 0/1."""
    scored = df.select(*_carried(df), model.probabilities(vector_to_array(F.col("features"))).alias("score"))
    return scored.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def score_boosted_multi(model: boosting.TreeModel, df: DataFrame) -> DataFrame:
    """``probs`` of the softmax and ``prediction`` = most probable class; all classes in one projection."""
    scored = df.select(*_carried(df), model.probabilities(vector_to_array(F.col("features"))).alias("probs"))
    return scored.withColumn("prediction", vectors.argmax(F.col("probs")))


def score_latent(model: Transformer, df: DataFrame) -> DataFrame:
    """``probs``, ``prediction``, ``score`` (class 1) and the embedding ``z`` (no NaN)."""
    scored = model.transform(df)
    probs = vector_to_array(F.col("probability"))
    z = vectors.nan_to_zero(vector_to_array(F.col("embedding")))
    return scored.select(
        *_carried(df),
        F.col("prediction").cast("int").alias("prediction"),
        probs.alias("probs"),
        vectors.element(probs, 1).alias("score"),
        z.alias("z"),
    )


# --- cross-validation -------------------------------------------------------


@dataclass
class CrossValidation:
    """Pooled held-out rows and the model of every fold."""

    oof: DataFrame
    models: list[Transformer]


def cross_validate(
    df: DataFrame, fit: Fit, score: Score, k: int, parallelism: int = 2, fit_tasks: int | None = None
) -> CrossValidation:
    """Fit on all folds but one, score the one left out, pool the scored rows.

    ``df`` should be a staged table partitioned by ``fold``: each fit then reads only its
    own folds. Fits of different folds run at the same time from driver threads; the data
    work is all on executors. ``fit_tasks`` bounds the tasks of each round of a fit, for small tables.
    """

    def run(fold: int) -> Transformer:
        train = train_split(df, fold)
        return fit(train.coalesce(fit_tasks) if fit_tasks else train)

    spark = df.sparkSession
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        models = list(pool.map(inheritable_thread_target(spark)(run), range(k)))
    return score_folds(df, models, score)


def score_folds(df: DataFrame, fitted: Sequence, score: Score) -> CrossValidation:
    """Every fold scored by the model that left it out."""
    return CrossValidation(pool_oof([score(m, test_split(df, i)) for i, m in enumerate(fitted)]), list(fitted))


# --- reports from fitted models ----------------------------------------------


def feature_importance(spark: SparkSession, model: boosting.TreeModel, names: Sequence[str]) -> DataFrame:
    """``(feature, importance)`` of a boosted model, normalised to sum 1 when not all zero."""
    rows = spark.createDataFrame(list(zip(names, model.importance(len(names)))), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature")


def mean_importance(fold_importances: Sequence[DataFrame]) -> DataFrame:
    return pool_oof(fold_importances).groupBy("feature").agg(F.avg("importance").alias("importance"))


def loss_curve(spark: SparkSession, heads: Sequence[Transformer]) -> DataFrame:
    """``(fold, iteration, loss)`` of every fold's class head."""
    rows = [(i, j, float(loss)) for i, h in enumerate(heads) for j, loss in enumerate(h.losses)]
    return spark.createDataFrame(rows, "fold int, iteration int, loss double")


def project_2d(df: DataFrame, embedding: str = "z") -> DataFrame:
    """Two-dimensional map of the embeddings: the input columns plus ``x`` and ``y``."""
    ready = df.withColumn("_z", array_to_vector(col(embedding)))
    plane = fit_embedding(ready, 2, "_z", "_xy").transform(ready)
    xy = vector_to_array(F.col("_xy"))
    return plane.select(*[col(c) for c in df.columns], xy[0].alias("x"), xy[1].alias("y"))
