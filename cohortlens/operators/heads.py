"""Neural class head with sigmoid layers and a softmax, fitted by distributed gradient sums.

The fit is that of Spark ML's ``MultilayerPerceptronClassifier`` (same starting weights, L-BFGS with a
strong Wolfe line search, same end conditions) and gives its model, but the gradients are worked out by
numpy: the rows are staged once in blocks of some thousand, dealt evenly over as many tasks as they
fill, and a pass is one job in which each task adds up loss and gradient of its rows. As there, the loss
is the average over groups of ``GROUP`` rows of a partition, and the last group may be smaller. The
driver holds the weights and the last ``CORRECTIONS`` steps, a task a few blocks and one sum: all bounded
by the network, not by rows. Where the sums of all tasks exceed ``DRIVER_BYTES``, they meet in tasks of
a second stage first.

Sums are taken in the order of partitions, so a task that is run again gives the same head. A label
that is missing or outside the classes and a feature that is missing or not finite are errors; a table
without rows gives the starting weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.numbers import col
from cohortlens.operators.boosting import BLOCKS_AT_ONCE, MOST_ROWS, TASK_ROWS, gathered, steady
from cohortlens.session import ship_package
from cohortlens.sources.staging import release, scratch_path

# Steps the search remembers, its end conditions, and those of the line search.
CORRECTIONS = 10
TOLERANCE, LEAST_SLOPE, FLAT_STEPS = 1e-6, 1e-8, 20
DECREASE, CURVATURE, TRIALS, WIDEN, LEAST_STEP = 1e-4, 0.9, 10, 1.5, 1e-10
#: Rows whose average counts once in the loss, and rows that run through the network together (some
#: groups): what they leave in between stays in the processor's cache.
GROUP, CHUNK = 128, 256
#: Bytes of gradients of all tasks up to which the driver adds them up itself, in each pass.
DRIVER_BYTES = 1 << 22

Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]

# --- the network ----------------------------------------------------------------


def _layers(widths: Sequence[int], flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and offsets of every layer, as views of the list."""
    out, at = [], 0
    for a, b in zip(widths, widths[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += (a + 1) * b
    return out


def add_gradient(widths: Sequence[int], flat: np.ndarray, x: np.ndarray, label: np.ndarray, held: np.ndarray) -> None:
    """Add the gradient of the cross entropy, averaged over each group of rows ``x``, and at the end loss and groups to ``held``."""
    layers, slopes = _layers(widths, flat), _layers(widths, held)
    last = len(layers) - 1
    for start in range(0, len(x), CHUNK):
        values, truth = x[start : start + CHUNK], label[start : start + CHUNK]
        n, kept = np.arange(len(values)), []
        rest = len(n) % GROUP
        share = np.where(n < len(n) - rest, 1 / GROUP, 1 / max(rest, 1))
        for i, (weights, offset) in enumerate(layers):
            kept.append(values)
            values = values @ weights
            values += offset
            if i < last:
                np.multiply(values, 0.5, out=values)
                np.tanh(values, out=values)
                values += 1
                values *= 0.5
        values -= values.max(axis=1, keepdims=True)
        reached = values[n, truth]
        np.exp(values, out=values)
        total = values.sum(axis=1, keepdims=True)
        held[-2] += float((np.log(total[:, 0]) - reached) @ share)
        held[-1] += -(-len(n) // GROUP)
        values /= total
        values[n, truth] -= 1
        values *= share[:, None]
        for i in range(last, -1, -1):
            slopes[i][0][...] += kept[i].T @ values
            slopes[i][1][...] += values.sum(axis=0)
            if i:
                values = values @ layers[i][0].T
                values *= kept[i]
                values *= 1 - kept[i]


# --- rows and passes --------------------------------------------------------------


def _checked_label(label: Column, n_classes: int) -> Column:
    value = label.cast("double")
    checked = F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit("Labels MUST NOT be Null or NaN")).cast("int"))
    said = F.concat(F.lit(f"Labels MUST be in [0, {n_classes}), but got "), value.cast("string"))
    outside = (value < 0) | (value >= n_classes)
    broken = F.raise_error(F.concat(F.lit("Labels MUST be Integers, but got "), value.cast("string"))).cast("int")
    checked = checked.when(value != F.floor(value), broken)
    return checked.when(outside, F.raise_error(said).cast("int")).otherwise(value.cast("int"))


def _checked_features(features: Column) -> Column:
    values = vector_to_array(features)
    endless = F.exists(values, lambda v: F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    none = F.raise_error(F.lit("Vectors MUST NOT be Null")).cast("array<double>")
    bad = F.raise_error(F.lit("Vector values MUST NOT be NaN or Infinity")).cast("array<double>")
    return F.when(features.isNull(), none).when(endless, bad).otherwise(values)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels and features of whole groups of rows; only the last block of a partition may end in a smaller one."""
    held = None
    for batch in gathered(batches):
        held = batch if held is None or not held.num_rows else pa.concat_batches([held, batch])
        whole = held.num_rows - held.num_rows % GROUP
        if whole:
            yield _packed(held.slice(0, whole))
        held = held.slice(whole)
    if held is not None and held.num_rows:
        yield _packed(held)


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts = batch.column(0), batch.column(1).flatten()
    return pa.RecordBatch.from_arrays([pa.array([p.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for p in parts], ["label", "x"])


_SUMS = ["task int", "sums binary"]


def _sum_rows(task: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([sums.tobytes()], pa.binary())], [s.split()[0] for s in _SUMS])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, first = None, 0
    for batch in batches:
        for task, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            one = np.frombuffer(sums.as_py())
            held, first = (one, task) if held is None else (held + one, first)
    if held is not None:
        yield _sum_rows(first, held)


def _pass(table: DataFrame, tasks: int, widths: Sequence[int], flat: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss over the groups of rows of ``table`` and its gradient."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(flat) + 2)
        for batch in batches:
            for labels, values in zip(*batch.columns):
                label = np.frombuffer(labels.as_buffer(), np.int32)
                x = np.frombuffer(values.as_buffer()).reshape(len(label), widths[0])
                add_gradient(widths, flat, x, label, held)
        if held[-1]:
            yield _sum_rows(TaskContext.get().partitionId(), held)

    schema = ", ".join(_SUMS)
    found = table.mapInArrow(partial, schema)
    if tasks * flat.nbytes > DRIVER_BYTES:
        groups = math.isqrt(tasks - 1) + 1
        grouped = found.repartition(groups, F.floor(F.col("task") / groups)).sortWithinPartitions("task")
        found = grouped.mapInArrow(_added, schema)
    total = np.zeros(len(flat) + 2)
    for r in sorted(found.collect(), key=lambda r: r["task"]):
        total += np.frombuffer(bytes(r["sums"]))
    return float(total[-2] / total[-1]), total[:-2] / total[-1]


# --- the search ---------------------------------------------------------------------


class _NoStep(Exception):
    """The line search found no step that lowers the loss enough."""


@dataclass
class _Point:
    """A place along a direction: step, loss, slope along the direction, weights and gradient."""

    step: float
    loss: float
    slope: float
    flat: np.ndarray
    gradient: np.ndarray


def _between(left: _Point, right: _Point) -> float:
    """The lowest place of the cubic through two points, at least a tenth of their distance from either."""
    width = right.step - left.step
    a = left.slope + right.slope - 3 * (left.loss - right.loss) / (left.step - right.step)
    root = a * a - left.slope * right.slope
    step = right.step - width * (right.slope + math.sqrt(root) - a) / (right.slope - left.slope + 2 * math.sqrt(root)) if root >= 0 else math.nan
    return min(max(step, left.step + 0.1 * width), left.step + 0.9 * width) if math.isfinite(step) else left.step + 0.5 * width


def _line_search(loss: Loss, at: _Point, way: np.ndarray, step: float) -> _Point:
    """A point along ``way`` that meets the strong Wolfe conditions."""

    def look(step: float) -> _Point:
        flat = at.flat + step * way
        value, gradient = loss(flat)
        return _Point(step, value, float(gradient @ way), flat, gradient)

    def high(point: _Point) -> bool:
        return point.loss > start.loss + DECREASE * point.step * start.slope

    def zoom(low: _Point, end: _Point) -> _Point:
        for _ in range(TRIALS):
            here = look(_between(*sorted((low, end), key=lambda p: p.step)))
            if high(here) or here.loss >= low.loss:
                end = here
                continue
            if abs(here.slope) <= CURVATURE * abs(start.slope):
                return here
            if here.slope * (end.step - low.step) >= 0:
                end = low
            low = here
        raise _NoStep

    low = start = _Point(0.0, at.loss, float(at.gradient @ way), at.flat, at.gradient)
    if not start.slope <= 0:
        raise _NoStep
    for i in range(TRIALS):
        here = look(step)
        if not math.isfinite(here.loss):
            step /= 2
            continue
        if high(here) or (i and here.loss >= low.loss):
            return zoom(low, here)
        if abs(here.slope) <= CURVATURE * abs(start.slope):
            return here
        if here.slope >= 0:
            return zoom(here, low)
        low, step = here, step * WIDEN
    raise _NoStep


def _way(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The direction of the search from the last changes of weights and gradient, newest first."""
    way, shares = -gradient, []
    for moved, turned in steps:
        shares.append(float(moved @ way) / float(moved @ turned))
        way = way - shares[-1] * turned
    if steps:
        moved, turned = steps[0]
        way = way * (float(moved @ turned) / float(turned @ turned))
    for (moved, turned), share in zip(reversed(steps), reversed(shares)):
        way = way + (share - float(turned @ way) / float(moved @ turned)) * moved
    return way


def minimise(loss: Loss, flat: np.ndarray, iterations: int) -> tuple[np.ndarray, list[float]]:
    """Weights of a low loss and the loss after each iteration, by L-BFGS.

    It ends after ``iterations``, where the loss has hardly fallen for ``FLAT_STEPS`` or the gradient is
    small beside it, or where the line search fails twice in a row.
    """
    value, gradient = loss(flat)
    at = _Point(0.0, value, 0.0, flat, gradient)
    losses, recent, steps, failed, turn = [value], [math.inf], [], False, 0
    while turn < iterations:
        flat_out = len(recent) > 1 and abs(at.loss - max(recent)) <= TOLERANCE * losses[0]
        if flat_out or np.linalg.norm(at.gradient) <= max(TOLERANCE * at.loss, LEAST_SLOPE):
            break
        try:
            with np.errstate(all="ignore"):
                way = _way(at.gradient, steps)
            found = _line_search(loss, at, way, 1.0 if turn else 1.0 / float(np.linalg.norm(way)))
            if found.step * float(np.linalg.norm(at.gradient)) < LEAST_STEP:
                raise _NoStep
        except _NoStep:
            if failed:
                break
            failed, steps = True, []
            losses.append(at.loss)
            continue
        steps = [(found.flat - at.flat, found.gradient - at.gradient), *steps][:CORRECTIONS]
        at, failed, turn = found, False, turn + 1
        losses.append(at.loss)
        recent = [*recent, at.loss][-FLAT_STEPS:]
    return at.flat, losses


# --- the fit ------------------------------------------------------------------------


def _model(spark: SparkSession, widths: Sequence[int], seed: int, features: str, label: str, flat: np.ndarray | None = None) -> MultilayerPerceptronClassificationModel:
    """Spark ML's model of the given weights, or of those it starts from: a fit of no iterations on a row of zeros."""
    row = spark.range(1).select(F.lit(0.0).alias(label), array_to_vector(F.array_repeat(F.lit(0.0), widths[0])).alias(features))
    given = {} if flat is None else {"initialWeights": Vectors.dense(flat)}
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=list(widths), maxIter=0, seed=seed, **given).fit(row)


def fit(df: DataFrame, widths: Sequence[int], iterations: int, seed: int, features: str = "features", label: str = "label") -> MultilayerPerceptronClassificationModel:
    """The head with layers of ``widths``; ``losses`` of the model holds the loss at the start and after each iteration."""
    spark = df.sparkSession
    ship_package(spark)
    start = np.array(_model(spark, widths, seed, features, label).weights.toArray())
    values = df.select(_checked_label(col(label), widths[-1]).alias("label"), _checked_features(col(features)).alias("x"))
    n = df.count()
    tasks = max(1, min(n // TASK_ROWS, max(spark.sparkContext.defaultParallelism, n // MOST_ROWS)))
    passes = steady(spark)
    passes.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCKS_AT_ONCE))
    passes.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BLOCKS_AT_ONCE))
    path = scratch_path(spark, "head")
    try:
        values.mapInArrow(_blocks, "label binary, x binary").repartition(tasks).write.parquet(path)
        table = passes.read.schema("label binary, x binary").parquet(path)
        n_tasks = table.rdd.getNumPartitions()
        flat, losses = (start, [math.nan]) if not n else minimise(lambda at: _pass(table, n_tasks, widths, at), start, iterations)
    finally:
        release(spark, [path])
    # A copy has no summary: that of the fit on a row of zeros would tell nothing.
    head = _model(spark, widths, seed, features, label, flat).copy({})
    head.clear(head.initialWeights)
    head.set(head.maxIter, iterations)
    head.losses = losses
    return head
