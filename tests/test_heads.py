"""The class head: its gradient, its losses beside Spark ML's, and rows it refuses."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.operators import heads, models

WIDTHS = [4, 6, 5, 3]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    label = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 0.5)
    data = [([float(v) for v in row], int(c)) for row, c in zip(x, label)]
    table = spark.createDataFrame(data, "x array<double>, label int")
    return table.withColumn("features", array_to_vector("x")).repartition(3).cache()


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    flat = rng.normal(size=sum((a + 1) * b for a, b in zip(WIDTHS, WIDTHS[1:])))
    x, label = rng.normal(size=(heads.CHUNK + 9, 4)), rng.integers(0, 3, heads.CHUNK + 9)

    def sums(at):
        held = np.zeros(len(at) + 2)
        heads.add_gradient(WIDTHS, at, x, label, held)
        return held

    found = sums(flat)
    assert found[-1] == 3
    for i in range(0, len(flat), 7):
        step = np.eye(len(flat))[i] * 1e-5
        assert found[i] == pytest.approx((sums(flat + step)[-2] - sums(flat - step)[-2]) / 2e-5, rel=1e-5, abs=1e-5)


def test_losses_and_weights_are_those_of_spark_ml(rows):
    whole = rows
    plain = MultilayerPerceptronClassifier(layers=[4, 64, 32, 3], maxIter=8, seed=42).fit(whole)
    head = models.fit_class_head(rows, 4, 3, iterations=8)
    assert head.losses == pytest.approx(list(plain.summary().objectiveHistory), rel=1e-6)
    assert np.allclose(head.weights.toArray(), plain.weights.toArray(), atol=1e-4)
    curve = models.loss_curve(rows.sparkSession, [head]).orderBy("iteration").collect()
    assert [r["loss"] for r in curve] == head.losses
    predicted = lambda m: [r["prediction"] for r in m.transform(whole).collect()]
    assert predicted(head) == predicted(plain)


def test_sums_of_many_tasks_meet_before_the_driver(rows, monkeypatch):
    whole = models.fit_class_head(rows, 4, 3, iterations=3)
    monkeypatch.setattr(heads, "TASK_ROWS", 30)
    monkeypatch.setattr(heads, "DRIVER_BYTES", 0)
    assert models.fit_class_head(rows, 4, 3, iterations=3).losses == pytest.approx(whole.losses, rel=1e-9)


def test_bad_rows_are_errors_and_no_rows_leave_the_start(rows):
    for bad in (F.lit(None).cast("int"), F.lit(3), F.lit(-1)):
        with pytest.raises(Exception, match="Labels MUST"):
            models.fit_class_head(rows.withColumn("label", bad), 4, 3, iterations=1)
    with pytest.raises(Exception, match="NaN or Infinity"):
        models.fit_class_head(rows.withColumn("features", array_to_vector(F.array(*[F.lit(float("nan"))] * 4))), 4, 3, iterations=1)
    empty = models.fit_class_head(rows.where("false"), 4, 3)
    assert len(empty.losses) == 1 and empty.weights.size == 4 * 64 + 64 + 64 * 32 + 32 + 32 * 3 + 3
