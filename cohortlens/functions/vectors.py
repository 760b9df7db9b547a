"""Expressions over ``array<double>`` columns: probabilities, embeddings, losses.

Everything here is a built-in higher-order function, so it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once a row, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def softmax(logits: Column) -> Column:
    """Class probabilities; shifted by the maximum so large logits do not overflow."""

    def shares(shifted: Column) -> Column:
        return once(total(shifted), lambda whole: F.transform(shifted, lambda e: e / whole))

    def below(values: Column) -> Column:
        return once(F.array_max(values), lambda peak: once(F.transform(values, lambda v: F.exp(v - peak)), shares))

    return once(logits, below)


def argmax(values: Column) -> Column:
    """Index of the largest value, the lowest index on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def element(values: Column, index: int) -> Column:
    return F.element_at(values, index + 1)


def top_k(probs: Column, k: int) -> Column:
    """Indices of the k largest values, best first, the lower index first on ties."""
    ranked = F.array_sort(F.transform(probs, lambda v, i: F.struct((-v).alias("neg"), i.alias("idx"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["idx"])


def in_top_k(label: Column, probs: Column, k: int) -> Column:
    return F.array_contains(top_k(probs, k), label.cast("int"))


def gather(values: Column, indices: Column) -> Column:
    """``values[i]`` for every 0-based index in ``indices``."""
    return F.transform(indices, lambda i: F.get(values, i))


def nan_to_zero(values: Column) -> Column:
    return F.transform(values, lambda v: F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v))


def one_vs_rest_probabilities(raw: Column) -> Column:
    """Normalised sigmoid of the per-class boosted margins (binary boosting uses ``2F``)."""
    logistic = F.transform(raw, lambda r: 1.0 / (1.0 + F.exp(-2.0 * r)))
    return F.transform(logistic, lambda s: s / total(logistic))


def squared_error(x: Column, x_recon: Column) -> Column:
    return total(F.zip_with(x, x_recon, lambda a, b: (a - b) * (a - b)))


def kl_to_standard_normal(mu: Column, log_var: Column) -> Column:
    """KL divergence of N(mu, exp(log_var)) from N(0, 1), summed over the dimensions."""
    terms = F.zip_with(mu, log_var, lambda m, v: 1.0 + v - m * m - F.exp(v))
    return total(terms) * -0.5


def cross_entropy(logits: Column, label: Column) -> Column:
    """``logsumexp(logits) - logits[label]``."""
    peak = F.array_max(logits)
    log_sum = peak + F.ln(total(F.transform(logits, lambda v: F.exp(v - peak))))
    return log_sum - F.get(logits, label.cast("int"))
