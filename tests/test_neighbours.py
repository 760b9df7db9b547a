"""The neighbour map: graph against brute force, weights, planted clusters against the linear map, edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import models, neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, z array<double>").repartition(4)


def distances(x):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    return far


def trust(x, plane, k=10):
    """Trustworthiness: 1 minus the penalty for neighbours in the plane that are far away in ``x``."""
    n = len(x)
    rank = np.argsort(np.argsort(distances(x), axis=1), axis=1) + 1
    near = np.argsort(distances(plane), axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, axis=1) - k, 0).sum()


def places(df):
    return np.array([[r["x"], r["y"]] for r in df.orderBy("row_id").collect()])


def clusters(n=360, seed=4):
    """Six groups in eight dimensions whose centres no plane keeps apart."""
    rng = np.random.default_rng(seed)
    return 4 * np.eye(8)[np.arange(n) % 6] + rng.normal(0, 0.5, (n, 8)), np.arange(n) % 6


def test_map_of_planted_clusters(spark):
    x, group = clusters()
    df = frame(spark, x).cache()
    mapped = places(neighbours.neighbour_map(df, epochs=40))
    linear = places(models.project_2d(df))
    own = lambda p: (group[np.argsort(distances(p), axis=1)[:, :10]] == group[:, None]).mean()
    print("trust", trust(x, mapped), trust(x, linear), "own", own(mapped), own(linear))
    assert trust(x, mapped) > trust(x, linear) + 0.05 and own(mapped) > 0.95 > own(linear)
    again = places(neighbours.neighbour_map(df.repartition(7), epochs=40))
    assert np.array_equal(mapped, again)


def graph(spark, x, **settings):
    points = frame(spark, x).select(F.col("row_id").alias("node"), F.col("z").alias("v"))
    found = neighbours.neighbour_graph(points, x.shape[1], len(x), **settings).collect()
    return {(r["a"], r["b"]): r["d"] for r in found}


def test_graph_of_one_block_is_exact(spark):
    x = np.random.default_rng(2).normal(size=(150, 5))
    far = distances(x)
    expected = {(i, int(j)): far[i, j] for i in range(150) for j in np.argsort(far[i], kind="stable")[:6]}
    found = graph(spark, x, k=6)
    assert found.keys() == expected.keys() and all(found[e] == pytest.approx(d) for e, d in expected.items())


def test_graph_of_many_blocks(spark):
    """Recall against brute force, and a place that holds a third of all rows."""
    x, _ = clusters(1500)
    x[:500] = x[0]
    found = graph(spark, x, k=10, block=128, tables=12)
    far = distances(x)
    hits = total = 0
    for i in range(500, 1500):
        own = set(np.argsort(far[i], kind="stable")[:10].tolist())
        hits, total = hits + sum((i, j) in found for j in own), total + 10
    print("recall", hits / total)
    assert hits / total > 0.9
    assert all(sum((i, j) in found and found[i, j] == 0 for j in range(500)) == 10 for i in range(0, 500, 50))


def test_weights(spark):
    rows = [(0, 1, 1.0), (0, 2, 2.0), (1, 0, 1.0), (2, 0, 2.0), (2, 1, 5.0)]
    found = {(r["a"], r["b"]): r["w"] for r in neighbours.edge_weights(spark.createDataFrame(rows, "a long, b long, d double")).collect()}
    far = np.exp(-2.0)
    assert found == pytest.approx({(0, 1): 1.0, (1, 0): 1.0, (0, 2): 1.0, (2, 0): 1.0, (1, 2): far, (2, 1): far})


def test_edges_of_the_map(spark):
    schema = "row_id long, z array<double>, x_old string"
    odd = [(None, [1.0, 2.0], "a"), (1, None, "b"), (2, [], "c"), (3, [float("nan"), 1.0], "d"), (4, [1.0], "e"), (5, [1.0, 2.0], "f"), (6, [9.0, 2.0], "g"), (7, [1.0, 3.0], "h")]
    found = {r["x_old"]: r["x"] for r in neighbours.neighbour_map(spark.createDataFrame(odd, schema), epochs=2).collect()}
    assert {k for k, v in found.items() if v is None} == {"b", "c", "d", "e"} and len(found) == 8
    few = {r["x_old"]: (r["x"], r["y"]) for r in neighbours.neighbour_map(spark.createDataFrame(odd[3:6], schema)).collect()}
    assert few == {"d": (None, None), "e": (0.0, 0.0), "f": (0.0, 0.0)}
    assert neighbours.neighbour_map(spark.createDataFrame([], schema)).count() == 0
    same = neighbours.neighbour_map(spark.createDataFrame([(i, [1.0, 1.0], "") for i in range(6)], schema), epochs=2).collect()
    assert len(same) == 6 and all(np.isfinite([r["x"], r["y"]]).all() for r in same)
