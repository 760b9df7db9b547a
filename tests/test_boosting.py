"""Histogram boosting: folds together and alone, losses, repeated tasks, and scores by columns."""

from __future__ import annotations

import dataclasses
import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import boosting, models
from cohortlens.session import ship_package

SETTINGS = boosting.Boosting(rounds=4, depth=3, step=0.3, row_share=0.8, column_share=0.7, min_weight=0.5, gamma=0.0, l1=0.1, l2=1.0, bins=32)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 5)), 2)
    label = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 1)
    data = [(i, [float(v) for v in row], int(c), i % 3) for i, (row, c) in enumerate(zip(x, label))]
    table = spark.createDataFrame(data, "row_id long, x array<double>, label int, fold int")
    return table.withColumn("features", array_to_vector("x")).repartition(4).cache()


def plain_fit(x, label, draw, columns, s, n_classes, cuts):
    """Second-order boosting by loops over rows: one model on all rows, trees as lists of (feature, cut, value)."""
    width = 1 if n_classes == 2 else n_classes
    margins, out = np.zeros((len(x), width)), [[] for _ in range(width)]
    soft = lambda g: np.sign(g) * max(abs(g) - s.l1, 0.0)
    for turn in range(s.rounds):
        trees = []
        for c in range(width):
            p = 1 / (1 + np.exp(-margins[:, 0])) if width == 1 else (lambda e: e[:, c] / e.sum(axis=1))(np.exp(margins - margins.max(axis=1, keepdims=True)))
            g, h = p - (label == (1 if width == 1 else c)), p * (1 - p) * (1 if width == 1 else 2)
            tree = boosting.Tree.leaf(s.depth)
            where = np.zeros(len(x), int)
            for node in range(2**s.depth - 1):
                here = (where == node) & draw(turn)
                if not here.any() or (node and tree.feature[(node - 1) // 2] < 0):
                    continue
                G, H = g[here].sum(), h[here].sum()
                if node == 0:
                    tree.value[0] = -s.step * soft(G) / (H + s.l2)
                best = (0.0, None)
                for f in range(x.shape[1]):
                    for cut in cuts[f] if columns[turn][c][f] else []:
                        left = here & (x[:, f] <= cut)
                        gl, hl = g[left].sum(), h[left].sum()
                        gain = soft(gl) ** 2 / (hl + s.l2) + soft(G - gl) ** 2 / (H - hl + s.l2) - soft(G) ** 2 / (H + s.l2)
                        if hl >= s.min_weight and H - hl >= s.min_weight and gain > best[0] + 1e-7:
                            best = (gain, (f, cut, gl, hl))
                if best[1] is not None and best[0] >= max(s.gamma, boosting.LEAST_GAIN):
                    f, cut, gl, hl = best[1]
                    tree.feature[node], tree.cut[node] = f, cut
                    tree.value[2 * node + 1] = -s.step * soft(gl) / (hl + s.l2)
                    tree.value[2 * node + 2] = -s.step * soft(G - gl) / (H - hl + s.l2)
                    inside = where == node
                    where[inside] = np.where(x[inside, f] <= cut, 2 * node + 1, 2 * node + 2)
            trees.append((tree, np.array(tree.value)[where]))
        for c, (tree, added) in enumerate(trees):
            margins[:, c] += added
            out[c].append(tree)
    return out, margins


@pytest.mark.parametrize("n_classes", [2, 3])
def test_trees_follow_the_definition(spark, rows, n_classes):
    own = rows.where("label < 2") if n_classes == 2 else rows
    settings = dataclasses.replace(SETTINGS, row_share=1.0)
    (model,) = boosting.fit(own, n_classes, settings, key="row_id")
    data = own.orderBy("row_id").collect()
    x, label = np.array([r.x for r in data]), np.array([r.label for r in data])
    rng, width = np.random.default_rng(settings.seed), 1 if n_classes == 2 else n_classes
    columns = []
    for _ in range(settings.rounds):
        drawn = np.argsort(rng.random((width, 5)), axis=1)[:, :4]
        columns.append([[f in own for f in range(5)] for own in drawn])
    cuts = boosting.quantile_cuts(own.select("x"), 5, settings.bins)
    trees, margins = plain_fit(x, label, lambda turn: np.ones(len(x), bool), columns, settings, n_classes, cuts)
    for found, expected in zip(model.trees, trees):
        for a, b in zip(found, expected):
            assert a.feature == b.feature and a.value == pytest.approx(b.value, abs=1e-6)
    scored = own.select("row_id", model.margins(F.col("x")).alias("m"), model.probabilities(F.col("x")).alias("p")).orderBy("row_id").collect()
    assert np.abs(np.array([r.m for r in scored]) - margins).max() < 1e-5
    if n_classes > 2:
        assert all(sum(r.p) == pytest.approx(1.0) for r in scored)


def test_folds_together_equal_folds_alone(rows):
    together = boosting.fit(rows, 3, SETTINGS, [0, 1, 2, None], key="row_id")
    for fold in (1, None):
        alone = boosting.fit(rows, 3, SETTINGS, [fold], key="row_id")[0]
        assert alone.trees == together[3 if fold is None else fold].trees
    assert together[0].trees != together[1].trees


def test_fit_does_not_depend_on_partitions(rows, monkeypatch):
    whole = boosting.fit(rows.coalesce(1), 3, SETTINGS, [0, None], key="row_id")
    monkeypatch.setattr(boosting, "REFRESH", 2)
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)
    pieces = boosting.fit(rows.repartition(7), 3, SETTINGS, [0, None], key="row_id")
    assert [m.trees for m in whole] == [m.trees for m in pieces]


def test_settings_bind(rows):
    own = rows.where("label < 2")
    splits = lambda **change: sum(f >= 0 for t in boosting.fit(own, 2, dataclasses.replace(SETTINGS, **change), key="row_id")[0].trees[0] for f in t.feature)
    plain = splits()
    assert plain > splits(gamma=5.0) and plain > splits(min_weight=30.0) and plain > splits(l2=200.0, gamma=0.5) and splits(l1=1e6) == 0
    one = boosting.fit(own, 2, dataclasses.replace(SETTINGS, column_share=0.2), key="row_id")[0]
    assert all(len({f for f in t.feature if f >= 0}) <= 1 for t in one.trees[0])


def test_odd_tables(spark, rows):
    empty = boosting.fit(rows.limit(0), 2, SETTINGS)
    assert empty[0].trees[0][0].value[0] == 0.0
    odd = rows.select("row_id", "features", F.when(F.col("row_id") % 2 == 0, F.col("label")).alias("label")).where("label is null or label < 2")
    known = boosting.fit(odd.where("label is not null"), 2, SETTINGS, key="row_id")[0]
    assert boosting.fit(odd, 2, SETTINGS, key="row_id")[0].trees == known.trees
    same = boosting.fit(rows.withColumn("features", array_to_vector(F.array(F.lit(1.0)))).where("label < 2"), 2, SETTINGS)[0]
    assert all(f < 0 for t in same.trees[0] for f in t.feature)


def test_trees_as_a_table(spark, rows):
    model = models.fit_boosted_multi(rows, weighted=True, rounds=3)
    again = boosting.TreeModel.from_table(model.table(spark))
    x = vector_to_array(F.col("features"))
    assert rows.where(model.probabilities(x) != again.probabilities(x)).count() == 0
    text = rows.select(model.probabilities(x))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "MapInArrow" not in text
    assert sum(model.importance(5)) == pytest.approx(1.0)


def test_two_types_are_a_softmax(rows):
    own = rows.where("label < 2")
    model = models.fit_boosted_multi(own, rounds=5)
    scored = models.score_boosted_multi(model, own).select("label", "prediction", "probs").collect()
    assert all(len(r.probs) == 2 and sum(r.probs) == pytest.approx(1.0) for r in scored)
    assert np.mean([r.label == r.prediction for r in scored]) > 0.7


def test_one_pass_for_all_folds(spark, rows):
    """A level is one job, however many folds."""
    tracker, counts = spark.sparkContext.statusTracker(), []
    for k in (1, 3):
        spark.sparkContext.setJobGroup(f"folds-{k}", "")
        models.fit_binary_folds(rows.where("label < 2"), k, rounds=2)
        counts.append(len(tracker.getJobIdsForGroup(f"folds-{k}")))
    spark.sparkContext.setJobGroup("other", "")
    assert counts[0] == counts[1]


def _bytes_to_driver(monkeypatch, fit):
    """Bytes the driver collects in the passes of a fit."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    held, collect = [], Classic.collect

    def noted(df):
        rows = collect(df)
        held.append(sum(len(v) if isinstance(v, (bytes, bytearray)) else 8 for r in rows for v in r))
        return rows

    monkeypatch.setattr(Classic, "collect", noted)
    fit()
    monkeypatch.setattr(Classic, "collect", collect)
    return max(held)


def test_the_driver_gets_splits_not_histograms(spark, monkeypatch):
    """Histograms of several tasks (here 11 models, 40 features) meet on executors, in every level."""
    x = F.array(*[F.sin(F.col("id") * (i + 1.5)) for i in range(40)])
    rows = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("int").alias("fold"), (F.sin(F.col("id") * 1.5) > 0).cast("int").alias("label"), array_to_vector(x).alias("features"))
    monkeypatch.setattr(boosting, "TASK_ROWS", 200, raising=False)
    fit = lambda: boosting.fit(rows.repartition(4), 2, dataclasses.replace(SETTINGS, rounds=1), [*range(10), None], key="row_id")
    assert _bytes_to_driver(monkeypatch, fit) < 1 << 19


def test_rows_of_few_files_are_dealt_over_the_cores(spark, monkeypatch):
    """A fit's passes run in as many tasks as the rows fill, also where they lie in one file."""
    tasks, level = set(), boosting._level
    monkeypatch.setattr(boosting, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(boosting, "_level", lambda *a: (tasks.add(a[-1]), level(*a))[1])
    rows = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), array_to_vector(F.array(F.sin("id"))).alias("features"))
    boosting.fit(rows.coalesce(1), 2, dataclasses.replace(SETTINGS, rounds=1), key="row_id")
    assert min(tasks) > 1


def test_features_and_margins_are_worked_out_once_a_row(spark):
    """A score evaluates its features once, not once a tree and class, and the softmax its logits once."""
    tree = boosting.Tree([0, 1, -1, -1, -1, -1, -1], [2.5, 0.5] + [0.0] * 5, [0] * 7, [0.0, 0.0, 3.0, 1.0, 2.0, 0.0, 0.0], [0.0] * 7)
    model = boosting.TreeModel([[tree, tree], [boosting.Tree.leaf(2)], [tree]], 2)
    plan = spark.range(5).select(model.probabilities(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") == 1
    found = [r[0] for r in spark.createDataFrame([([1.0, 1.0],), ([3.0, 0.0],), ([1.0, 0.0],), ([float("nan"), 0.0],), (None,)], "x array<double>").select(model.margins(F.col("x"))).collect()]
    assert found == [[4.0, 0.0, 2.0], [6.0, 0.0, 3.0], [2.0, 0.0, 1.0], [6.0, 0.0, 3.0], [None, 0.0, None]]


def test_fits_side_by_side_ship_the_package_once():
    """A cluster refuses a second file of the same name."""
    sent = []

    def add(path):
        time.sleep(0.05)
        if sent:
            raise ValueError("was already registered with a different path")
        sent.append(path)

    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="shipped-by-four", addPyFile=add))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(ship_package, [session] * 4))
    assert len(sent) == 1


def test_blocks_do_not_follow_the_batches_of_the_session(spark, rows):
    """Fits side by side may get the batch size of each other's passes: a block of eight rows costs as much as one of thousands."""
    values = rows.select(F.xxhash64("row_id").alias("uid"), "label", "fold", "x").coalesce(1)
    cuts = boosting.quantile_cuts(values, 5, 32)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        assert boosting._binned(values, cuts).count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
