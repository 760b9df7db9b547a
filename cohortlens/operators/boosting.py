"""Second-order boosted trees, grown by distributed histograms; all folds and all classes in one pass.

Every feature is cut at quantiles once and a row becomes a few bytes of bin numbers, staged with its
label and fold in blocks of some thousand rows: a block is one staged row with a column of bytes per
field, the bins feature by feature, so a pass has no cost per row but that of numpy. The rows are dealt
evenly over as many tasks as they fill. A level of a tree is one job: each task adds up the first and
second derivatives of the loss per (model, node, feature, bin) of its rows, the histograms of a node
meet in one task of the next stage, which looks for the best split there, and the driver gets one row
per node (where the histograms of all tasks together take at most ``DRIVER_BYTES``, they meet on the
driver; a fit has some hundred levels). The fold is part of the histogram's key: the models of all folds, the model of all rows and the k
classes of a softmax grow together, so a level costs one job however many models there are. Sums
are kept as whole numbers (a fixed point), so they do not depend on the order of tasks, and a task
that is run again gives the same trees.

Margins are brought up to date every ``REFRESH`` rounds and staged with the rows; in between a pass
applies only the trees since. What the driver holds (trees, best splits) and what a task holds
(histograms) is bounded by models, nodes, features and bins, not by rows.

A split's gain is ``T(GL)^2/(HL+l2) + T(GR)^2/(HR+l2) - T(G)^2/(H+l2)`` with ``T`` the soft threshold
by ``l1``; it must reach ``gamma`` and leave ``min_weight`` of second derivatives on both sides. A
leaf's value is ``-step T(G)/(H+l2)``. Rows with ``x <= cut`` go left; NaN goes right.

Defined results: rows without a label (null, or outside the classes) teach nothing; equal gains take
the first feature and the lowest cut; a feature with one value is never cut; a table without rows
gives trees of one leaf with value zero. Null or repeated keys only share their draw of rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import vectors
from cohortlens.functions.numbers import col
from cohortlens.session import ship_package
from cohortlens.sources.staging import checkpoint_root, release, scratch_path

#: Rounds after which margins are staged, and the steps of the fixed point in one unit.
REFRESH, UNIT = 10, 1 << 28
#: Bytes of histograms up to which the driver adds them up itself, in each level; the splits are the same.
DRIVER_BYTES = 1 << 18
#: Rows a task of a pass reads at least, and rows that are worth a task beyond those that run at once.
TASK_ROWS, MOST_ROWS = 10_000, 4_000_000
#: Blocks that travel to a worker together, and rows of a block at least (but the last of a task).
BLOCKS_AT_ONCE, BLOCK_ROWS = 8, 10_000
#: Least gain of a split besides ``gamma``.
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Boosting:
    """Settings of a fit; shares are drawn anew for every tree."""

    rounds: int
    depth: int
    step: float
    row_share: float
    column_share: float
    min_weight: float
    gamma: float
    l1: float
    l2: float
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """A binary tree by place: the children of ``i`` are ``2i + 1`` (left) and ``2i + 2``."""

    feature: list[int]
    cut: list[float]
    bin: list[int]
    value: list[float]
    gain: list[float]

    @classmethod
    def leaf(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls([-1] * n, [0.0] * n, [0] * n, [0.0] * n, [0.0] * n)

    def ends(self) -> np.ndarray:
        """Values by place in the last level, where rows in a leaf above it went on to the left."""
        value, inner = list(self.value), len(self.value) // 2
        for node in range(inner):
            if self.feature[node] < 0:
                value[2 * node + 1] = value[2 * node + 2] = value[node]
        return np.array(value[inner:])


TREE_SCHEMA = "class int, tree int, node int, feature int, cut double, value double, gain double"
_JSON_SCHEMA = "array<array<struct<feature:array<int>,cut:array<double>,value:array<double>>>>"


@dataclass
class TreeModel:
    """Trees per class (one list for a 0/1 label); a margin is the sum of the leaves a row falls into."""

    trees: list[list[Tree]] = field(default_factory=list)
    depth: int = 0

    def margins(self, features: Column) -> Column:
        """Margin of each class from an array of features, by built-in functions only."""
        # A leaf above the last level looks at a zero put before the features, which sends every row to the left.
        stated = [
            [{"feature": [f + 1 for f in t.feature], "cut": [c if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)], "value": [0.0] * (len(t.value) // 2) + t.ends().tolist()} for t in own]
            for own in self.trees
        ]
        every = F.from_json(F.lit(json.dumps(stated)), _JSON_SCHEMA)
        levels = F.sequence(F.lit(1), F.lit(self.depth)) if self.depth else F.array().cast("array<int>")
        given = F.coalesce(F.concat(F.array(F.lit(0.0)), features), F.array(F.lit(0.0)))

        def leaf(tree: Column, x: Column) -> Column:
            def down(node: Column, _: Column) -> Column:
                return 2 * node + 1 + (F.get(x, F.get(tree["feature"], node)) > F.get(tree["cut"], node)).cast("int")

            return F.get(tree["value"], F.aggregate(levels, F.lit(0), down))

        # The features are worked out once a row, not once a tree.
        return vectors.once(given, lambda x: F.transform(every, lambda own: F.aggregate(own, F.lit(0.0), lambda total, tree: total + leaf(tree, x))))

    def probabilities(self, features: Column) -> Column:
        """Probability of every class; those of a 0/1 label are of 0 and 1."""
        margins = self.margins(features)
        if len(self.trees) > 1:
            return vectors.softmax(margins)
        return F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-m))).getItem(0)

    def importance(self, n_features: int) -> list[float]:
        """Share of each feature in the gain of all splits (all zero without a split)."""
        total = np.zeros(n_features)
        for tree in (t for own in self.trees for t in own):
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += gain
        return (total / total.sum() if total.sum() else total).tolist()

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows, one per node."""
        rows = [
            (c, i, node, *parts)
            for c, own in enumerate(self.trees)
            for i, t in enumerate(own)
            for node, parts in enumerate(zip(t.feature, t.cut, t.value, t.gain))
        ]
        return spark.createDataFrame(rows, TREE_SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame) -> TreeModel:
        """The model a table of its nodes holds; trees are small, whatever they were fitted on."""
        found: dict[int, dict[int, list]] = {}
        for r in table.orderBy("class", "tree", "node").collect():
            found.setdefault(r["class"], {}).setdefault(r["tree"], []).append(r)
        trees = [[Tree([r["feature"] for r in t], [r["cut"] for r in t], [0] * len(t), [r["value"] for r in t], [r["gain"] for r in t]) for t in own.values()] for own in found.values()]
        size = max((len(t.feature) for own in trees for t in own), default=1)
        return cls(trees, (size + 1).bit_length() - 2)


# --- rows -------------------------------------------------------------------


def quantile_cuts(values: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each feature of the array column ``x``, at most ``bins - 1``."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = values.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000).alias(f"c{i}") for i in range(n_features)]).first()
    return [np.unique(np.array(c or [], float)) for c in found]


_BLOCK = ["uid", "label", "fold", "bins", "margins"]
_BLOCK_DDL = ", ".join(f"{name} binary" for name in _BLOCK)


def _block(*parts: np.ndarray | bytes) -> pa.RecordBatch:
    """One staged row: uid, label and fold of its rows, bins (features x rows), margins (models and classes x rows; empty: zero)."""
    return pa.RecordBatch.from_arrays([pa.array([p if isinstance(p, bytes) else p.tobytes()], pa.binary()) for p in parts], _BLOCK)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``BLOCK_ROWS`` at least: where fits run side by side, one may get the batch size of another's passes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            n = batch.num_rows
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
            found = np.stack([np.searchsorted(c, values[:, i], "left") for i, c in enumerate(cuts)]).astype(np.uint8)
            # Rows without a fold are left out by no model.
            uid, label, fold = batch.column(0), batch.column(1), batch.column(2).fill_null(-1)
            yield _block(*(c.to_numpy(zero_copy_only=False) for c in (uid, label, fold)), found, b"")

    return rows.mapInArrow(cut, _BLOCK_DDL)


# --- one pass -----------------------------------------------------------------


@dataclass
class _Pass:
    """What a task needs: the models that grow, the trees its margins lack, and the trees of this round."""

    settings: Boosting
    n_classes: int  # margins of a model: 1 for a 0/1 label
    folds: list[int | None]  # the fold each model leaves out
    weights: np.ndarray  # models x labels
    n_features: int
    recent: list[list[Tree]]  # rounds x (models and classes)
    growing: list[Tree]
    columns: np.ndarray  # (models and classes) x features: those a tree may look at
    round: int
    level: int

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """Uid, label, fold, bins (features x rows) and margins (models and classes x rows) of each block."""
        for i in range(batch.num_rows):
            uid, label, fold, bins, held = (column[i].as_buffer() for column in batch.columns)
            uid, label, fold = np.frombuffer(uid, np.int64), np.frombuffer(label, np.int32), np.frombuffer(fold, np.int32)
            n, width = len(uid), len(self.growing)
            bins = np.frombuffer(bins, np.uint8).reshape(self.n_features, n)
            margins = np.frombuffer(held, np.float64).reshape(width, n).copy() if held.size else np.zeros((width, n))
            for trees in self.recent:
                for own, tree in zip(margins, trees):
                    own += tree.ends()[self.places(tree, bins, self.settings.depth)]
            yield uid, label, fold, bins, margins

    def places(self, tree: Tree, bins: np.ndarray, levels: int) -> np.ndarray:
        """The place of each row among the nodes of a level; from a leaf above it rows go on to the left."""
        at = np.zeros(bins.shape[1], np.uint8 if levels <= 8 else np.int64)
        for level in range(levels):
            right = np.zeros(len(at), bool)
            for place in range(2**level):
                node = 2**level - 1 + place
                if tree.feature[node] >= 0:
                    right |= (at == place) & (bins[tree.feature[node]] > tree.bin[node])
            at = (at << 1) | right
        return at

    def drawn(self, uid: np.ndarray) -> np.ndarray:
        """The rows a tree learns from, by a hash of key and round: a model draws the same rows alone and beside others."""
        with np.errstate(over="ignore"):
            mixed = uid.astype(np.uint64) + np.uint64((self.settings.seed * 1_000_003 + self.round + 1) % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        return (mixed ^ (mixed >> np.uint64(31))) <= np.uint64(min(int(self.settings.row_share * 2.0**64), 2**64 - 1))

    def derivatives(self, margins: np.ndarray, label: np.ndarray, model: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First and second derivative of the loss of each row, for each class of a model."""
        own = margins[model * self.n_classes : (model + 1) * self.n_classes]
        if self.n_classes == 1:
            p = 1 / (1 + np.exp(-own))
            truth = [label == 1]
        else:
            p = np.exp(own - own.max(axis=0))
            p /= p.sum(axis=0)
            truth = [label == c for c in range(self.n_classes)]
        weight = self.weights[model][label]
        for c, hit in enumerate(truth):
            # Of a softmax the second derivative is taken twice, as its classes move together.
            yield (p[c] - hit) * weight, np.maximum((1 if self.n_classes == 1 else 2) * p[c] * (1 - p[c]), 1e-16) * weight

    def histograms(self, batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        """Block number (model and class, node) to sums of both derivatives per feature and bin."""
        s, nodes = self.settings, 1 << self.level
        # Sums of a tree: node, derivative, feature, bin. Totals are read from the first feature, drawn or not.
        sums = np.zeros((len(self.growing), nodes, 2, self.n_features, s.bins), np.int64)
        looked = [[f for f in range(self.n_features) if not f or own[f]] for own in self.columns]
        for batch in batches:
            for uid, label, fold, bins, margins in self.read(batch):
                drawn = np.flatnonzero(self.drawn(uid))
                if not len(drawn):
                    continue
                label, fold = label[drawn], fold[drawn]
                bins, margins = np.take(bins, drawn, axis=1), np.take(margins, drawn, axis=1)
                cells = bins.astype(np.int64)
                at = np.empty(len(drawn), np.int64)
                for m, out in enumerate(self.folds):
                    learns = None if out is None else fold != out
                    for c, both in enumerate(self.derivatives(margins, label, m)):
                        axis = m * self.n_classes + c
                        # Rows of the fold that is left out add zeros.
                        g, h = (np.rint((d if learns is None else d * learns) * UNIT) for d in both)
                        start = self.places(self.growing[axis], bins, self.level).astype(np.int64) * s.bins if nodes > 1 else 0
                        for f in looked[axis]:
                            np.add(cells[f], start, out=at)
                            for i, d in enumerate((g, h)):
                                sums[axis, :, i, f] += np.bincount(at, d, nodes * s.bins).astype(np.int64).reshape(nodes, s.bins)
        blocks = {}
        for axis, tree in enumerate(self.growing):
            for place in range(nodes):
                # Rows in a leaf above the level are done.
                above = (nodes - 1 + place - 1) // 2
                if (nodes == 1 or tree.feature[above] >= 0) and sums[axis, place].any():
                    blocks[(axis << self.level) + place] = sums[axis, place].reshape(2, -1)
        return blocks

    def best_split(self, block: np.ndarray, columns: np.ndarray) -> tuple:
        """Feature, bin, gain, and both sums left, right and here of the best split of a node."""
        s = self.settings
        sums = block.reshape(2, self.n_features, s.bins)
        left = np.cumsum(sums, axis=2)
        here = left[:, 0, -1] / UNIT
        right = (left[:, :, -1:] - left) / UNIT
        left = left / UNIT
        gain = self.gain(*left) + self.gain(*right) - self.gain(*here)
        gain[(left[1] < s.min_weight) | (right[1] < s.min_weight) | ~columns[:, None]] = -np.inf
        f, b = divmod(int(np.argmax(gain)), s.bins)
        return f, b, float(gain[f, b]), *left[:, f, b].tolist(), *right[:, f, b].tolist(), *here.tolist()

    def gain(self, g, h):
        t = np.sign(g) * np.maximum(np.abs(g) - self.settings.l1, 0)
        return t * t / np.maximum(h + self.settings.l2, 1e-12)

    def leaf(self, g: float, h: float) -> float:
        s = self.settings
        return float(-s.step * np.sign(g) * max(abs(g) - s.l1, 0.0) / max(h + s.l2, 1e-12))


_SPLIT = ["block long", "feature int", "bin int", "gain double", "gl double", "hl double", "gr double", "hr double", "g double", "h double"]
_SPLIT_NAMES = [s.split()[0] for s in _SPLIT]
_SPLIT_TYPES = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 7]


def _level(table: DataFrame, one: _Pass, tasks: int) -> list[tuple]:
    """The best split of every node of a level (``_SPLIT``): one row per node that has rows; ``tasks`` read ``table``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = one.histograms(batches)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([b.tobytes() for b in found.values()], pa.binary())], ["block", "sums"])

    def splits(parts: Iterator[tuple[int, bytes]]) -> list[tuple]:
        held: dict[int, np.ndarray] = {}
        for number, sums in parts:
            block = np.frombuffer(sums, np.int64)
            held[number] = held[number] + block if number in held else block
        return [(number, *one.best_split(block, one.columns[number >> one.level])) for number, block in held.items()]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = splits((n, s.as_py()) for batch in batches for n, s in zip(batch.column(0).to_pylist(), batch.column(1)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SPLIT_TYPES)], _SPLIT_NAMES)

    blocks = len(one.growing) << one.level
    size = blocks * one.n_features * one.settings.bins * 16
    parts = table.mapInArrow(partial, "block long, sums binary")
    if size * tasks <= DRIVER_BYTES:
        return splits((r["block"], bytes(r["sums"])) for r in parts.collect())
    return [tuple(r) for r in parts.repartition(max(1, min(blocks, size >> 22)), "block").mapInArrow(best, ", ".join(_SPLIT)).collect()]


def _refreshed(table: DataFrame, one: _Pass) -> DataFrame:
    """The rows with the margins of all trees so far."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in one.read(batch):
                yield _block(*block)

    return table.mapInArrow(apply, _BLOCK_DDL)


def steady(spark: SparkSession) -> SparkSession:
    """A session of the same application that does not plan anew between stages.

    A level is two short stages of known sizes, and there are hundreds of them.
    """
    checkpoint_root(spark)
    steady = spark.newSession()
    steady.conf.set("spark.sql.adaptive.enabled", "false")
    return steady


def _staged(spark: SparkSession, rows: DataFrame, name: str, paths: list[str]) -> tuple[DataFrame, int]:
    """Staged rows, read by ``spark``, and the tasks that read them; their folder is noted in ``paths``."""
    path = scratch_path(spark, name)
    paths.append(path)
    rows.write.parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    return table, table.rdd.getNumPartitions()


def fit(rows: DataFrame, n_classes: int, settings: Boosting, leave_out: Sequence[int | None] = (None,), weights: np.ndarray | None = None,
        features: str = "features", label: str = "label", key: str | None = None, softmax: bool | None = None) -> list[TreeModel]:
    """A model for each entry of ``leave_out``: fitted on the rows of all other folds, or on all rows (None).

    ``n_classes`` = 2 is a 0/1 label with one list of trees unless ``softmax`` is set, more are a
    softmax. ``weights`` (models x labels) are the rows' weights. ``key`` decides which rows a tree draws (default: their place).
    """
    spark = rows.sparkSession
    ship_package(spark)
    uid = F.monotonically_increasing_id() if key is None else F.xxhash64(col(key))
    fold = col("fold") if "fold" in rows.columns else F.lit(-1)
    known = rows.where(col(label).between(0, n_classes - 1))
    values = known.select(uid.alias("uid"), col(label).cast("int").alias("label"), fold.cast("int").alias("fold"), vector_to_array(col(features)).alias("x"))
    found = values.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    width = n_classes if (n_classes > 2 if softmax is None else softmax) else 1
    n_models, n_features = len(leave_out), found["width"] or 0
    models = [TreeModel([[] for _ in range(width)], settings.depth) for _ in leave_out]
    if not n_features:
        for model in models:
            model.trees = [[Tree.leaf(settings.depth)] for _ in range(width)]
        return models
    weights = np.ones((n_models, n_classes)) if weights is None else np.asarray(weights, float)
    # Fits may run side by side, so each keeps a list of its own folders.
    paths: list[str] = []
    try:
        cuts = quantile_cuts(values, n_features, settings.bins)
        passes = steady(spark)
        passes.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCKS_AT_ONCE))
        passes.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BLOCKS_AT_ONCE))
        tasks = max(1, min(found["n"] // TASK_ROWS, max(spark.sparkContext.defaultParallelism, found["n"] // MOST_ROWS)))
        table, tasks = _staged(passes, _binned(values.repartition(tasks), cuts), "binned", paths)
        rng, recent = np.random.default_rng(settings.seed), []
        chosen = max(1, math.ceil(settings.column_share * n_features))
        for turn in range(settings.rounds):
            # Each class draws its columns; every model draws as if it grew alone.
            drawn = np.argsort(rng.random((width, n_features)), axis=1)[:, :chosen]
            columns = np.zeros((n_models * width, n_features), bool)
            for axis in range(n_models * width):
                columns[axis, drawn[axis % width]] = True
            growing = [Tree.leaf(settings.depth) for _ in range(n_models * width)]
            one = _Pass(settings, width, list(leave_out), weights, n_features, recent, growing, columns, turn, 0)
            _grow(table, one, tasks, cuts)
            for axis, tree in enumerate(growing):
                models[axis // width].trees[axis % width].append(tree)
            recent = [*recent, growing]
            if len(recent) == REFRESH and turn + 1 < settings.rounds:
                before, one.recent = list(paths), recent
                table, tasks = _staged(table.sparkSession, _refreshed(table, one), "margins", paths)
                release(spark, before)
                del paths[:-1]
                recent = []
    finally:
        release(spark, paths)
    return models


def _grow(table: DataFrame, one: _Pass, tasks: int, cuts: list[np.ndarray]) -> None:
    """Split the trees of a round level by level, all of them together."""
    for level in range(one.settings.depth):
        one.level, split = level, False
        for row in _level(table, one, tasks):
            r = dict(zip(_SPLIT_NAMES, row))
            axis, node = r["block"] >> level, 2**level - 1 + (r["block"] & ((1 << level) - 1))
            tree = one.growing[axis]
            if level == 0:
                tree.value[0] = one.leaf(r["g"], r["h"])
            if r["gain"] >= max(one.settings.gamma, LEAST_GAIN) and r["bin"] < len(cuts[r["feature"]]):
                tree.feature[node], tree.bin[node], tree.gain[node] = r["feature"], r["bin"], r["gain"]
                tree.cut[node] = float(cuts[r["feature"]][r["bin"]])
                tree.value[2 * node + 1], tree.value[2 * node + 2] = one.leaf(r["gl"], r["hl"]), one.leaf(r["gr"], r["hr"])
                split = True
        if not split:
            break
