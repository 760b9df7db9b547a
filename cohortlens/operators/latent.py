"""Reconstruction and joint loss of the latent model, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import vectors

# Loss weights of the study (the type model uses 200 in cross-validation).
BETA = 5.0
LAMBDA_CLASS = 20.0
LAMBDA_CLASS_TYPE_FOLDS = 200.0


def reconstruct(embedding_model, z: Column) -> Column:
    """Features rebuilt from an embedding: ``W z`` with the fitted components ``W``."""
    weights = embedding_model.pc.toArray()
    rows = [F.array(*[F.lit(float(w)) for w in row]) for row in weights]
    return F.array(*[vectors.total(F.zip_with(z, row, lambda a, b: a * b)) for row in rows])


def recon_error(df: DataFrame, x: str = "x", x_recon: str = "x_recon", out: str = "recon_error") -> DataFrame:
    return df.withColumn(out, vectors.squared_error(F.col(x), F.col(x_recon)))


def loss_parts(df: DataFrame, beta: float = BETA, lambda_class: float = LAMBDA_CLASS) -> DataFrame:
    """Per sample: reconstruction, KL, class and total loss.

    Reads ``x, x_recon, mu, log_var, logits, label``.
    """
    parts = (
        df.withColumn("recon", vectors.squared_error(F.col("x"), F.col("x_recon")))
        .withColumn("kl", vectors.kl_to_standard_normal(F.col("mu"), F.col("log_var")))
        .withColumn("cls", vectors.cross_entropy(F.col("logits"), F.col("label")))
    )
    return parts.withColumn("loss", F.col("recon") + beta * F.col("kl") + lambda_class * F.col("cls"))


def joint_loss(df: DataFrame, beta: float = BETA, lambda_class: float = LAMBDA_CLASS) -> DataFrame:
    """One row: totals over samples with a finite loss, and averages over all samples."""
    parts = loss_parts(df, beta, lambda_class)
    good = ~F.isnan("loss")
    names = ("loss", "recon", "kl", "cls")
    summed = parts.agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0.0)).alias(c) for c in names]
    )
    return summed.select("n", *names, *[F.try_divide(F.col(c), F.col("n")).alias(f"avg_{c}") for c in names])
