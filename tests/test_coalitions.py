"""Kernel attributions: exact cases, all coalitions by brute force, and the error of a budget."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import coalitions, explain

NAMES = [f"f{i}" for i in range(8)]


def rough(x):
    """A score with interactions of two and three features."""
    return np.tanh(x[..., 0] * x[..., 1] + x[..., 2]) + x[..., 3] * x[..., 4] * x[..., 5] + 0.5 * x[..., 6] - np.abs(x[..., 7])


def rough_score(df):
    x = [F.get("x", F.lit(i)) for i in range(8)]
    f = F.tanh(x[0] * x[1] + x[2]) + x[3] * x[4] * x[5] + 0.5 * x[6] - F.abs(x[7])
    return df.withColumn("scores", F.array(f, 1.0 - f))


def exact(x, background, f):
    """Shapley values by the definition."""
    d = len(x)
    value = {}
    for s in range(d + 1):
        for members in combinations(range(d), s):
            mixed = background.copy()
            mixed[:, list(members)] = x[list(members)]
            value[members] = f(mixed).mean()
    phi = np.zeros(d)
    for j in range(d):
        others = [i for i in range(d) if i != j]
        for s in range(d):
            for members in combinations(others, s):
                phi[j] += factorial(s) * factorial(d - s - 1) / factorial(d) * (value[tuple(sorted((*members, j)))] - value[members])
    return phi


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(34, 8))
    columns = ", ".join(f"{n} double" for n in NAMES)
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], f"row_id int, {columns}").cache()
    truth = {i: exact(x[i], x[4:], rough) for i in range(4)}
    return table.where("row_id < 4"), table.where("row_id >= 4"), truth


def error(found, truth):
    phi = {(r["row_id"], r["class"], r["feature"]): r["phi"] for r in found.collect()}
    assert len(phi) == 4 * 2 * 8
    return max(abs(phi[i, c, n] - (1 - 2 * c) * truth[i][j]) for i in range(4) for c in (0, 1) for j, n in enumerate(NAMES))


def test_all_coalitions_give_the_definition(tables):
    rows, background, truth = tables
    found = coalitions.kernel_attributions(rows, NAMES, rough_score, background)
    assert error(found, truth) < 1e-9


def test_a_budget_against_orders_of_as_many_copies(tables):
    """72 coalitions (2,190 scored copies of a row) against 8 orders a background row (2,160): under half the error."""
    rows, background, truth = tables
    kernel = coalitions.kernel_attributions(rows, NAMES, rough_score, background, budget=72)
    found = error(kernel, truth)
    for seed in (42, 1, 2):
        orders = explain.shapley_attributions(rows, NAMES, rough_score, background, rounds=8, seed=seed)
        assert found < 0.5 * error(orders, truth)
    sums = kernel.groupBy("row_id", "class").agg(F.sum("phi").alias("s"), F.first("base").alias("base"))
    direct = rough_score(rows.withColumn("x", F.array(*NAMES))).select("row_id", F.posexplode("scores").alias("class", "f"))
    for r in sums.join(direct, ["row_id", "class"]).collect():
        assert r["s"] + r["base"] == pytest.approx(r["f"])


def test_chosen_coalitions():
    masks, weights = coalitions.choose(8, 10_000)
    assert len(masks) == 254 and weights.sum() == pytest.approx(sum(7 / (s * (8 - s)) for s in range(1, 8)))
    for d, budget in ((20, 300), (5, 0), (7, 41), (2, 0), (3, 6)):
        masks, weights = coalitions.choose(d, budget)
        assert len(masks) <= max(budget, 2 * d) and len({m.tobytes() for m in masks}) == len(masks)
        assert {tuple(1 - m) for m in masks} == {tuple(m) for m in masks} and 0 < masks.sum(axis=1).min() and masks.sum(axis=1).max() < d
        adds, own = coalitions.coefficients(masks, weights)
        assert np.allclose(adds.sum(axis=1), 0) and own.sum() == pytest.approx(1)
    assert len(coalitions.choose(1, 10)[0]) == 0


def test_edges(spark, tables):
    rows, background, _ = tables
    one = lambda df: df.withColumn("scores", F.array(3.0 * F.get("x", F.lit(0))))
    found = coalitions.kernel_attributions(rows, ["f0"], one, background).collect()
    mean = background.agg(F.avg("f0")).first()[0]
    assert len(found) == 4 and all(r["phi"] == pytest.approx(3 * (r["value"] - mean)) for r in found)
    assert coalitions.kernel_attributions(rows.limit(0), NAMES, rough_score, background).count() == 0
    for args in ((rows, NAMES, rough_score, background.limit(0)), (rows, [], rough_score, background)):
        with pytest.raises(ValueError):
            coalitions.kernel_attributions(*args)
