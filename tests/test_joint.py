"""The joint latent model: gradients, folds together and alone, losses, a planted nonlinear set, saved tables."""

from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import joint, latent, models

SMALL_NET = joint.Joint(4, 3, dimension=2, hidden=(6, 5), epochs=3, steps=2, rate=0.01, beta=0.7, lambda_class=3.0)


def frame(spark, x, label, folds=3):
    data = [(i, [float(v) for v in row], int(c), i % folds) for i, (row, c) in enumerate(zip(x, label))]
    table = spark.createDataFrame(data, "row_id long, x array<double>, label int, fold int")
    return table.withColumn("features", array_to_vector("x"))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    return frame(spark, x, (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)).repartition(3).cache()


def test_gradient_against_differences():
    s, rng = SMALL_NET, np.random.default_rng(1)
    x, label = rng.normal(size=(7, 4)), rng.integers(0, 3, 7)
    noise, flat = s.noise(np.arange(7), 2), s.start() + rng.normal(0, 0.1, s.start().size)
    total = lambda f: joint.losses(s, joint.outputs(s, f, x, noise), x, label)[0].sum()
    found = joint.gradient(s, flat, x, label, noise)
    for i in range(flat.size):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert found[i] == pytest.approx((total(flat + step) - total(flat - step)) / 2e-6, rel=1e-4, abs=1e-5)
    assert found[flat.size] == 7 and found[flat.size + 1] == pytest.approx(total(flat))


def test_drawn_points_are_standard_normal_and_differ_by_epoch():
    s = dataclasses.replace(SMALL_NET, dimension=8)
    drawn = s.noise(np.arange(50_000), 4)
    assert np.abs(drawn.mean(axis=0)).max() < 0.02 and np.abs(np.cov(drawn.T) - np.eye(8)).max() < 0.03
    assert np.array_equal(drawn[17:18], s.noise(np.array([17]), 4)) and not np.array_equal(drawn, s.noise(np.arange(50_000), 5))


def test_folds_together_and_alone(rows):
    together = joint.fit(rows, SMALL_NET, [0, 1, None], key="row_id")
    alone = joint.fit(rows, SMALL_NET, [1], key="row_id")[0]
    np.testing.assert_allclose(together[1].flat, alone.flat, atol=1e-9)
    np.testing.assert_allclose(together[1].history, alone.history, atol=1e-9)
    assert [h[5] for m in together for h in m.history] == [200.0] * 6 + [300.0] * 3
    without = joint.fit(rows.where("fold != 1").drop("fold"), SMALL_NET, key="row_id")[0]
    np.testing.assert_allclose(without.flat, alone.flat, atol=1e-9)


def test_sums_that_meet_in_tasks(rows, monkeypatch):
    whole = joint.fit(rows, SMALL_NET, [0, None], key="row_id")
    monkeypatch.setattr(joint, "DRIVER_BYTES", 0)
    monkeypatch.setattr(joint, "SLICE", 50)
    sliced = joint.fit(rows, SMALL_NET, [0, None], key="row_id")
    for a, b in zip(whole, sliced):
        np.testing.assert_allclose(a.flat, b.flat, atol=1e-9)


def test_parts_of_an_epoch_are_those_of_loss_parts(spark, rows):
    """With one step an epoch, an epoch's losses are those of the parameters before it at the points it drew."""
    one = dataclasses.replace(SMALL_NET, steps=1)
    before, after = (joint.fit(rows, dataclasses.replace(one, epochs=e), key="row_id")[0] for e in (2, 3))
    scored = rows.withColumn("out", before.outputs(F.col("x"), F.xxhash64("row_id"), epoch=2))
    found = latent.joint_loss(scored.select("x", "label", "out.*"), one.beta, one.lambda_class).first()
    assert [found[f"avg_{p}"] for p in joint.PARTS] == pytest.approx(after.history[2][:4])
    curves = joint.loss_curves(spark, [before, after]).collect()
    assert [(r["fold"], r["epoch"]) for r in curves] == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    for r in curves:
        assert r["loss"] == pytest.approx(r["recon"] + one.beta * r["kl"] + one.lambda_class * r["cls"])


def test_embedding_separates_what_a_linear_one_cannot(spark):
    """By nearest neighbours: the class head is not linear, so classes need not lie on two sides of a line."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 4)) * [1.0, 1.0, 1.5, 1.5]
    label = (x[:, 0] * x[:, 1] > 0).astype(int)
    table = frame(spark, x, label).coalesce(2).cache()
    s = joint.Joint(4, 2, dimension=2, hidden=(32, 16), epochs=60, steps=4, rate=0.01, beta=0.1, lambda_class=20.0)
    model = joint.fit(table, s, [0], key="row_id")[0]
    losses = [h[0] for h in model.history]
    assert losses[-1] < 0.5 * losses[0]
    train, test = table.where("fold != 0"), table.where("fold = 0")

    def share_of_near(embedded):
        """Held-out rows whose 15 nearest training rows in the embedding mostly have their label."""
        found = embedded.orderBy("row_id").select("fold", "label", "z").collect()
        z, y, held = np.array([r["z"] for r in found]), np.array([r["label"] for r in found]), np.array([r["fold"] == 0 for r in found])
        far = ((z[held][:, None] - z[~held][None]) ** 2).sum(axis=2)
        votes = y[~held][np.argsort(far, axis=1)[:, :15]].mean(axis=1) > 0.5
        return (votes == y[held]).mean()

    linear = models.fit_embedding(train, 2)
    assert share_of_near(linear.transform(table).withColumn("z", vector_to_array("embedding"))) < 0.65
    assert share_of_near(joint.score(model, table)) > 0.9
    assert joint.score(model, test).select(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.9


def test_the_rate_is_halved_on_a_plateau():
    adam = joint._Adam(dataclasses.replace(SMALL_NET, rate=1.0))
    rates = []
    for loss in [5.0, 4.0] + [4.0] * 12:
        adam.after(loss)
        rates.append(adam.rate)
    assert rates == [1.0] * 7 + [0.5] * 6 + [0.25]


def test_saved_as_a_table(spark, rows, tmp_path):
    model = joint.fit(rows, SMALL_NET, key="row_id")[0]
    model.table(spark).write.parquet(str(tmp_path / "model"))
    read = joint.JointModel.from_table(spark.read.parquet(str(tmp_path / "model")))
    assert read.settings == model.settings and np.array_equal(read.flat, model.flat) and read.history == model.history


def test_rows_that_teach_nothing(spark, rows):
    plain = joint.fit(rows.drop("fold"), SMALL_NET, key="row_id")[0]
    more = spark.createDataFrame(
        [(1000, [1.0, 2.0, 3.0, 4.0], None), (1001, [1.0, 2.0, 3.0, 4.0], 3), (1002, [float("nan")] * 4, 0), (1003, [1e200] * 4, 1)],
        "row_id long, x array<double>, label int",
    ).withColumn("features", array_to_vector("x"))
    with_them = joint.fit(rows.drop("fold").unionByName(more), SMALL_NET, key="row_id")[0]
    np.testing.assert_allclose(with_them.flat, plain.flat, atol=1e-9)
    assert [h[5] for h in with_them.history] == [300.0] * 3
    empty = joint.fit(rows.limit(0), SMALL_NET, [0], key="row_id")[0]
    assert np.array_equal(empty.flat, SMALL_NET.start()) and [h[5] for h in empty.history] == [0.0] * 3
    scored = joint.score(plain, more.select("row_id", "features").where("row_id = 1002")).first()
    assert scored["z"] == [0.0, 0.0] and np.isnan(scored["probs"]).all()


def test_sums_of_several_tasks_meet_on_executors(spark, monkeypatch):
    """A step sends one sum a model to the driver where the sums of its tasks would exceed a small bound."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    held, collect = [], Classic.collect

    def noted(df):
        out = collect(df)
        held.append(sum(len(r["sums"]) for r in out if "sums" in r))
        return out

    table = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("int").alias("fold"), (F.col("id") % 3).cast("int").alias("label"), array_to_vector(F.array(*[F.sin(F.col("id") * (i + 1.5)) for i in range(8)])).alias("features"))
    monkeypatch.setattr(joint, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(Classic, "collect", noted)
    settings = joint.Joint(8, 3, epochs=1, steps=1)
    joint.fit(table.repartition(5), settings, [*range(10), None], key="row_id")
    assert 0 < max(held) < 2 * 11 * 8 * settings.start().size
