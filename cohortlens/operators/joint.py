"""Latent model trained jointly: encoder, decoder and class head under one loss, by distributed gradient sums.

An encoder gives each row a normal distribution in the latent space (``mu``, ``log_var``); a point
drawn from it is decoded back to the features and, by a second network, to class scores. The loss of
a row is that of ``latent.loss_parts``: squared error of the reconstruction, ``beta`` times the
divergence from the standard normal, ``lambda_class`` times the cross entropy. The mean ``mu`` is
the row's embedding.

The rows are staged once, split by a hash of their key into ``steps`` folders. A step is one job over
one folder: each task runs the networks forward and backward on its rows and adds up the gradient and
the four parts of the loss for every model, and the driver moves the parameters (Adam, clipped
gradients, a rate that is halved when the loss of an epoch has not fallen for a while). Models that
leave out different folds learn in the same jobs. The driver holds parameters and their two moments,
a task one sum per model: both are bounded by the networks, not by rows. Where the sums of all tasks
exceed ``DRIVER_BYTES``, slices of them meet in tasks of a second stage.

The point drawn for a row depends on key, epoch and seed only, and sums are taken in the order of
partitions, so a task that is run again gives the same model, and a model learns the same alone and
beside others.

Defined results: rows whose label is null or outside the classes, whose features are missing, or
whose loss is not finite teach nothing and count in no loss; a step without rows changes nothing; a
table without rows gives the starting networks and losses of zero rows. Scoring a row with missing
features gives missing outputs (the embedding has zeros in their place).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.functions import vectors
from cohortlens.functions.numbers import col
from cohortlens.operators import latent
from cohortlens.operators.boosting import MOST_ROWS, steady
from cohortlens.operators.folds import SEED
from cohortlens.session import ship_package
from cohortlens.sources.staging import release, scratch_path

# Slope of the leaky units, Adam's settings, weight decay, clipping and the schedule of the rate.
SLOPE = 0.2
FADE_FIRST, FADE_SECOND, LEAST = 0.9, 0.999, 1e-8
DECAY = 1e-5
LARGEST_GRADIENT = 1.0
PATIENCE, FACTOR, THRESHOLD = 5, 0.5, 1e-4
#: Numbers of a gradient that travel together between stages.
SLICE = 1 << 16
#: Bytes of gradients of all tasks up to which the driver adds them up itself, in each step.
DRIVER_BYTES = 1 << 20
#: Rows that run through the networks together: what they leave in between stays in the processor's cache.
CHUNK = 1024
#: Rows a task of a step reads at least.
TASK_ROWS = 1_000
PARTS = ("loss", "recon", "kl", "cls")


@dataclass(frozen=True)
class Joint:
    """Settings of a fit: an epoch reads every row once, in ``steps`` changes of the parameters."""

    n_features: int
    n_classes: int
    dimension: int = 8
    hidden: tuple[int, ...] = (64, 32)
    epochs: int = 100
    steps: int = 4
    rate: float = 5e-3
    beta: float = latent.BETA
    lambda_class: float = latent.LAMBDA_CLASS
    seed: int = SEED

    def widths(self) -> dict[str, list[int]]:
        """Layer widths of the five networks."""
        turned = list(reversed(self.hidden))
        return {
            "encoder": [self.n_features, *self.hidden],
            "mu": [self.hidden[-1], self.dimension],
            "log_var": [self.hidden[-1], self.dimension],
            "decoder": [self.dimension, *turned, self.n_features],
            "head": [self.dimension, *[max(1, h // 2) for h in turned], self.n_classes],
        }

    def shapes(self) -> list[tuple[str, int, int]]:
        return [(name, a, b) for name, widths in self.widths().items() for a, b in zip(widths, widths[1:])]

    def start(self) -> np.ndarray:
        """The parameters before training, one list of numbers."""
        rng = np.random.default_rng(self.seed)
        parts = []
        for name, a, b in self.shapes():
            scale = np.sqrt((1.0 if name in ("mu", "log_var") else 2.0) / a) * (0.1 if name == "log_var" else 1.0)
            parts += [rng.normal(0.0, scale, a * b), np.zeros(b)]
        return np.concatenate(parts)

    def layers(self, flat: np.ndarray) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
        """Weights and offsets of every layer, as views of the list."""
        out: dict[str, list] = {}
        at = 0
        for name, a, b in self.shapes():
            out.setdefault(name, []).append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += (a + 1) * b
        return out

    def noise(self, uid: np.ndarray, epoch: int) -> np.ndarray:
        """Standard normal numbers of each row in an epoch, by a hash of its key."""
        with np.errstate(over="ignore"):
            place = np.uint64((self.seed * 1_000_003 + epoch) % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
            columns = np.arange(1, 2 * self.dimension + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
            mixed = (uid.astype(np.uint64)[:, None] ^ place) + columns
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
            mixed ^= mixed >> np.uint64(31)
        even = ((mixed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        radius, angle = np.sqrt(-2 * np.log(even[:, : self.dimension])), 2 * np.pi * even[:, self.dimension :]
        return radius * np.cos(angle)


def _forward(layers: list, values: np.ndarray, linear_end: bool) -> tuple[np.ndarray, list]:
    kept = []
    for i, (weights, offset) in enumerate(layers):
        before = values @ weights + offset
        kept.append((values, before))
        values = before if linear_end and i == len(layers) - 1 else np.maximum(before, SLOPE * before)
    return values, kept


def _backward(layers: list, kept: list, slope: np.ndarray, linear_end: bool) -> tuple[list, np.ndarray]:
    """Gradients of the layers and of what went into them."""
    grads: list = [None] * len(layers)
    for i in range(len(layers) - 1, -1, -1):
        values, before = kept[i]
        if not (linear_end and i == len(layers) - 1):
            slope = slope * np.where(before > 0, 1.0, SLOPE)
        grads[i] = (values.T @ slope, slope.sum(axis=0))
        slope = slope @ layers[i][0].T
    return grads, slope


def outputs(s: Joint, flat: np.ndarray, x: np.ndarray, noise: np.ndarray | None = None) -> dict:
    """What the networks give for rows ``x``; without ``noise`` the mean is decoded."""
    nets = s.layers(flat)
    deep, kept = _forward(nets["encoder"], x, False)
    mu, log_var = (_forward(nets[n], deep, True)[0] for n in ("mu", "log_var"))
    spread = np.exp(0.5 * log_var)
    z = mu if noise is None else mu + noise * spread
    x_recon, kept_decoder = _forward(nets["decoder"], z, True)
    logits, kept_head = _forward(nets["head"], z, True)
    return {
        "x_recon": x_recon, "mu": mu, "log_var": log_var, "logits": logits, "deep": deep, "spread": spread,
        "encoder": kept, "decoder": kept_decoder, "head": kept_head,
    }


def losses(s: Joint, out: dict, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Loss, reconstruction, divergence and class loss of each row (4 x rows)."""
    recon = ((out["x_recon"] - x) ** 2).sum(axis=1)
    kl = -0.5 * (1 + out["log_var"] - out["mu"] ** 2 - np.exp(out["log_var"])).sum(axis=1)
    peak = out["logits"].max(axis=1, keepdims=True)
    cls = np.log(np.exp(out["logits"] - peak).sum(axis=1)) + peak[:, 0] - out["logits"][np.arange(len(x)), label]
    return np.stack([recon + s.beta * kl + s.lambda_class * cls, recon, kl, cls])


def gradient(s: Joint, flat: np.ndarray, x: np.ndarray, label: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Sum over rows of the loss's gradient, followed by the number of rows and the sums of the four parts."""
    with np.errstate(all="ignore"):
        out = outputs(s, flat, x, noise)
        parts = losses(s, out, x, label)
        good = np.isfinite(parts).all(axis=0)
        if not good.all():
            x, label, noise, parts = x[good], label[good], noise[good], parts[:, good]
            out = outputs(s, flat, x, noise)
    nets = s.layers(flat)
    odds = np.exp(out["logits"] - out["logits"].max(axis=1, keepdims=True)) if len(x) else out["logits"]
    odds = odds / odds.sum(axis=1, keepdims=True)
    odds[np.arange(len(x)), label] -= 1
    decoder, from_decoder = _backward(nets["decoder"], out["decoder"], 2 * (out["x_recon"] - x), True)
    head, from_head = _backward(nets["head"], out["head"], s.lambda_class * odds, True)
    z = from_decoder + from_head
    slope_mu = z + s.beta * out["mu"]
    slope_var = z * noise * out["spread"] * 0.5 + s.beta * 0.5 * (np.exp(out["log_var"]) - 1)
    ends = {n: [(out["deep"].T @ slope, slope.sum(axis=0))] for n, slope in (("mu", slope_mu), ("log_var", slope_var))}
    encoder, _ = _backward(nets["encoder"], out["encoder"], slope_mu @ nets["mu"][0][0].T + slope_var @ nets["log_var"][0][0].T, False)
    ordered = {"encoder": encoder, **ends, "decoder": decoder, "head": head}
    sums = [part.ravel() for name in s.widths() for pair in ordered[name] for part in pair]
    return np.concatenate([*sums, [len(x)], parts.sum(axis=1)])


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    """Rows of an array of lists; missing rows and numbers are NaN."""
    out = np.full((len(values), width), np.nan)
    known = np.asarray(values.is_valid())
    out[known] = values.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.ravel()))


@dataclass
class JointModel:
    """Fitted networks and, per epoch, ``(loss, recon, kl, cls, rate, rows)``: averages over the rows."""

    settings: Joint
    flat: np.ndarray
    history: list[tuple] = field(default_factory=list)

    def outputs(self, x: Column, uid: Column | None = None, epoch: int = 0) -> Column:
        """Struct of ``x_recon, mu, log_var, logits``; with ``uid`` at the points drawn in that epoch of training."""
        s, flat = self.settings, self.flat

        def run(values: pa.Array, drawn: pa.Array) -> pa.Array:
            rows = _matrix(values, s.n_features)
            noise = None if drawn.null_count else s.noise(drawn.to_numpy(zero_copy_only=False), epoch)
            with np.errstate(all="ignore"):
                out = outputs(s, flat, rows, noise)
            names = ["x_recon", "mu", "log_var", "logits"]
            return pa.StructArray.from_arrays([_lists(out[n]) for n in names], names)

        run.__annotations__ = {"values": pa.Array, "drawn": pa.Array, "return": pa.Array}
        kind = "struct<x_recon:array<double>,mu:array<double>,log_var:array<double>,logits:array<double>>"
        return F.arrow_udf(run, kind)(x, F.lit(None).cast("long") if uid is None else uid)

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows: settings once, then every layer's weights (last row: its offsets)."""
        rows = [("settings", 0, 0, None, json.dumps(asdict(self.settings)))]
        rows += [("history", i, 0, [float(v) for v in h], None) for i, h in enumerate(self.history)]
        for name, layers in self.settings.layers(self.flat).items():
            for i, (weights, offset) in enumerate(layers):
                rows += [(name, i, j, w.tolist(), None) for j, w in enumerate(np.vstack([weights, offset]))]
        return spark.createDataFrame(rows, "part string, layer int, line int, numbers array<double>, text string")

    @staticmethod
    def from_table(table: DataFrame) -> JointModel:
        found = {(r["part"], r["layer"], r["line"]): r for r in table.collect()}
        given = json.loads(found["settings", 0, 0]["text"])
        s = Joint(**{**given, "hidden": tuple(given["hidden"])})
        numbers = [found[name, i, j]["numbers"] for name, w in s.widths().items() for i, a in enumerate(w[:-1]) for j in range(a + 1)]
        epochs = sorted(k[1] for k in found if k[0] == "history")
        return JointModel(s, np.concatenate([np.asarray(n) for n in numbers]), [tuple(found["history", e, 0]["numbers"]) for e in epochs])


# --- the fit ------------------------------------------------------------------


def _sums(table: DataFrame, s: Joint, flats: np.ndarray, leave_out: Sequence[int | None], epoch: int, tasks: int) -> np.ndarray:
    """Gradient, rows and loss parts of every model over the rows of ``table``."""
    width = flats.shape[1] + 1 + len(PARTS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(leave_out), width))
        for batch in batches:
            if not batch.num_rows:
                continue
            for some in (batch.slice(at, CHUNK) for at in range(0, batch.num_rows, CHUNK)):
                uid, label, fold = (some.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                x, noise = _matrix(some.column(3), s.n_features), s.noise(uid, epoch)
                for m, out in enumerate(leave_out):
                    learns = np.ones(len(uid), bool) if out is None else fold != out
                    if learns.any():
                        held[m] += gradient(s, flats[m], x[learns], label[learns], noise[learns])
        part, rows = TaskContext.get().partitionId(), []
        for m in range(len(leave_out)):
            rows += [(m, at // SLICE, part, held[m, at : at + SLICE].tobytes()) for at in range(0, width, SLICE)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["model", "slice", "part", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for m, i, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                one = np.frombuffer(sums.as_py())
                held[m, i] = held[m, i] + one if (m, i) in held else one
        if held:
            columns = [[m for m, _ in held], [i for _, i in held], [0] * len(held), [v.tobytes() for v in held.values()]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["model", "slice", "part", "sums"])

    schema = "model int, slice int, part int, sums binary"
    found = table.mapInArrow(partial, schema)
    if tasks > 1 and tasks * flats.size * 8 > DRIVER_BYTES:
        slices = len(leave_out) * -(-width // SLICE)
        found = found.repartition(slices, "model", "slice").sortWithinPartitions("model", "slice", "part").mapInArrow(added, schema)
    total = np.zeros((len(leave_out), width))
    for r in sorted(found.collect(), key=lambda r: (r["model"], r["slice"], r["part"])):
        one = np.frombuffer(bytes(r["sums"]))
        total[r["model"], r["slice"] * SLICE : r["slice"] * SLICE + len(one)] += one
    return total


class _Adam:
    """Parameters of one model with their moments, and the schedule of the rate."""

    def __init__(self, s: Joint):
        self.flat, self.rate, self.turn = s.start(), s.rate, 0
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.best, self.waited = np.inf, 0

    def step(self, slope: np.ndarray) -> None:
        size = float(np.linalg.norm(slope))
        slope = slope * min(1.0, LARGEST_GRADIENT / (size + 1e-6)) + DECAY * self.flat
        self.turn += 1
        self.first = FADE_FIRST * self.first + (1 - FADE_FIRST) * slope
        self.second = FADE_SECOND * self.second + (1 - FADE_SECOND) * slope * slope
        first, second = self.first / (1 - FADE_FIRST**self.turn), self.second / (1 - FADE_SECOND**self.turn)
        self.flat = self.flat - self.rate * first / (np.sqrt(second) + LEAST)

    def after(self, loss: float) -> None:
        """Halve the rate when the loss has not fallen by its ten-thousandth for more than ``PATIENCE`` epochs."""
        if loss < self.best * (1 - THRESHOLD):
            self.best, self.waited = loss, 0
        else:
            self.waited += 1
        if self.waited > PATIENCE:
            self.rate, self.waited = self.rate * FACTOR, 0


def fit(
    rows: DataFrame, settings: Joint, leave_out: Sequence[int | None] = (None,), features: str = "features", label: str = "label",
    key: str | None = None,
) -> list[JointModel]:
    """A model for each entry of ``leave_out``: trained on the rows of all other folds, or on all rows (None)."""
    spark, s = rows.sparkSession, settings
    ship_package(spark)
    uid = F.monotonically_increasing_id() if key is None else F.xxhash64(col(key))
    fold = F.coalesce(col("fold"), F.lit(-1)) if "fold" in rows.columns else F.lit(-1)
    known = rows.where(col(label).between(0, s.n_classes - 1) & col(features).isNotNull())
    values = known.select(uid.alias("uid"), col(label).cast("int").alias("label"), fold.cast("int").alias("fold"), vector_to_array(col(features)).alias("x"))
    path = scratch_path(spark, "joint")
    moving = [_Adam(s) for _ in leave_out]
    models = [JointModel(s, m.flat) for m in moving]
    paths = [path]
    try:
        n = values.count()
        tasks = max(1, min(n // (s.steps * TASK_ROWS), max(spark.sparkContext.defaultParallelism, n // (s.steps * MOST_ROWS))))
        # The hash that splits the rows is not the one that draws their points.
        values.repartition(tasks).withColumn("step", F.pmod(F.xxhash64("uid", F.lit(s.seed)), F.lit(s.steps)).cast("int")).write.partitionBy("step").parquet(path)
        schema = StructType(list(values.schema.fields)).add("step", "integer")
        staged = steady(spark).read.schema(schema).parquet(path)
        tables = [staged.where(F.col("step") == i).drop("step") for i in range(s.steps)]
        tasks = [t.rdd.getNumPartitions() for t in tables]
        for epoch in range(s.epochs):
            seen = np.zeros((len(moving), 1 + len(PARTS)))
            for table, n_tasks in zip(tables, tasks):
                sums = _sums(table, s, np.stack([m.flat for m in moving]), leave_out, epoch, n_tasks)
                size = moving[0].flat.size
                for m, one, total in zip(moving, sums, seen):
                    n = one[size]
                    total += one[size:]
                    if n:
                        m.step(one[:size] / n)
            for m, model, (n, *parts) in zip(moving, models, seen.tolist()):
                averages = [p / n if n else 0.0 for p in parts]
                model.history.append((*averages, m.rate, n))
                m.after(averages[0])
        for m, model in zip(moving, models):
            model.flat = m.flat
    finally:
        release(spark, paths)
    return models


# --- scores and reports ---------------------------------------------------------


def score(model: JointModel, df: DataFrame, features: str = "features") -> DataFrame:
    """``probs``, ``prediction``, ``score`` (class 1), the embedding ``z`` (no NaN) and ``recon_error``."""
    carried = [col(c) for c in df.columns if c not in (features, "weight")]
    x = vector_to_array(col(features))
    given = df.select(*carried, x.alias("_x"), model.outputs(x).alias("_out"))
    probs = vectors.softmax(F.col("_out.logits"))
    return (
        given.withColumn("probs", probs)
        .withColumn("prediction", vectors.argmax(F.col("probs")))
        .withColumn("score", vectors.element(F.col("probs"), 1))
        .withColumn("z", vectors.nan_to_zero(F.col("_out.mu")))
        .withColumn("recon_error", vectors.squared_error(F.col("_x"), F.col("_out.x_recon")))
        .drop("_x", "_out")
    )


def loss_curves(spark: SparkSession, models: Sequence[JointModel]) -> DataFrame:
    """``(fold, epoch, loss, recon, kl, cls, rate, n)``: the four curves of every fold, averages over its rows."""
    rows = [(i, e, *h[:5], int(h[5])) for i, m in enumerate(models) for e, h in enumerate(m.history)]
    return spark.createDataFrame(rows, "fold int, epoch int, loss double, recon double, kl double, cls double, rate double, n long")
