"""A map of embeddings that keeps neighbours together: nearest-neighbour graph, edge weights, layout.

The graph: rows meet in blocks and every row keeps the nearest of those it met. A table of up to
``block`` rows is one block, and the graph is exact. A larger one is cut ``tables`` times by random
directions at their medians, anew each time, into cells of about half a block; a cell that holds more
(many rows in one place) is cut further by a hash. Rows that no cut brings together are missed.

Weights fall with the distance beyond the nearest neighbour, relative to the mean of these distances, and
are made symmetric. The layout starts from the linear map; in every epoch each row is drawn to its
neighbours by their weights and pushed away from ``pushes`` others chosen by a hash. An epoch is two
joins and one aggregation over edges, written before the next one; the step shrinks to zero. Forces are
added up as whole numbers, so the map depends on rows, keys and seed only.

Defined results: rows whose embedding is null, empty, of another length than most, or not finite get no
place (null ``x`` and ``y``); fewer than three rows with an embedding all get (0, 0); equal embeddings
are neighbours at distance zero. Keys must be unique, else rows of one key may change places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.numbers import col
from cohortlens.operators import models
from cohortlens.operators.boosting import steady
from cohortlens.operators.folds import SEED, number_rows
from cohortlens.session import ship_package
from cohortlens.sources.staging import record, release, scratch_path, stage

NEIGHBOURS, BLOCK, TABLES = 15, 1_024, 12
EPOCHS, PUSHES = 60, 10
#: Repulsion against attraction, the largest force of one pair, and the spread of the linear map at the start.
BALANCE, LARGEST, SPREAD = 5.0, 4.0, 10.0
#: Steps of the fixed point in one unit of force.
UNIT = float(1 << 30)


def _cells(points: DataFrame, size: int, depth: int, tables: int, seed: int) -> DataFrame:
    """``node``, ``v``, ``tbl`` and ``code``: the cell of every row in every table."""
    cuts = np.random.default_rng([seed, size]).normal(size=(size, tables * depth))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) @ cuts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float64()))], ["node", "v", "p"])

    projected = stage(points.mapInArrow(project, "node long, v array<double>, p array<double>"), "projected")
    medians = projected.agg(F.array(*[F.percentile_approx(F.get("p", F.lit(i)), 0.5, 1_000) for i in range(tables * depth)])).first()[0]
    above = F.zip_with("p", F.array(*[F.lit(m) for m in medians]), lambda p, m: (p > m).cast("int"))
    bits = projected.withColumn("bits", above)
    codes = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.array_join(F.slice("bits", t * depth + 1, depth), ""))
    return bits.select("node", "v", F.posexplode(codes).alias("tbl", "code"))


def neighbour_graph(points: DataFrame, size: int, rows: int, k: int = NEIGHBOURS, block: int = BLOCK, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """``a``, ``b``, ``d``: of each node the ``k`` nearest others that it met, by Euclidean distance, ties by number.

    ``points`` are ``node long`` and ``v array<double>`` of length ``size``; ``rows`` is their count.
    """
    if rows <= block:
        cells = points.withColumns({"tbl": F.lit(0), "code": F.lit("")})
    else:
        cells = _cells(points, size, math.ceil(math.log2(2 * rows / block)), tables, seed)
    cells = stage(cells, "cells")
    sizes = cells.groupBy("tbl", "code").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    # Cells without a cut of their own are one part; the hash is taken per table, so parts differ between them.
    part = F.pmod(F.xxhash64("node", "tbl", F.lit(seed)), F.col("parts")).cast("int")
    placed = cells.join(sizes, ["tbl", "code"]).withColumn("part", part)

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        node, x = rows["node"].to_numpy(), np.stack(rows["v"].to_numpy())
        order = np.argsort(node)
        node, x = node[order], x[order]
        m = min(k, len(node) - 1)
        if m < 1:
            return pd.DataFrame({"a": [], "b": [], "d": []})
        out = []
        for low in range(0, len(node), 256):
            far = np.sqrt(((x[low : low + 256, None, :] - x[None]) ** 2).sum(axis=2))
            own = np.arange(low, low + len(far))
            far[np.arange(len(far)), own] = np.inf
            best = np.argsort(far, axis=1, kind="stable")[:, :m]
            out.append(pd.DataFrame({"a": np.repeat(node[own], m), "b": node[best].ravel(), "d": np.take_along_axis(far, best, axis=1).ravel()}))
        return pd.concat(out)

    met = placed.groupBy("tbl", "code", "part").applyInPandas(nearest, "a long, b long, d double")
    once = met.groupBy("a", "b").agg(F.min("d").alias("d"))
    # At most k rows of each table.
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return once.withColumn("place", place).where(F.col("place") <= k).drop("place")


def edge_weights(graph: DataFrame) -> DataFrame:
    """``a``, ``b``, ``w`` in both directions: ``p + q - pq`` of the two ends' weights ``exp(-(d - nearest) / mean excess)``."""
    ends = graph.groupBy("a").agg(F.min("d").alias("least"), F.avg("d").alias("mean"))
    excess = F.col("mean") - F.col("least")
    own = F.when(excess > 0, F.exp(-(F.col("d") - F.col("least")) / excess)).otherwise(1.0)
    one = graph.join(ends, "a").select("a", "b", own.alias("w"))
    both = one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    joined = both.groupBy("a", "b").agg(F.min("w").alias("p"), F.max("w").alias("q"), F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("n") == 1, F.col("q")).otherwise(F.col("p") + F.col("q") - F.col("p") * F.col("q"))
    edges = joined.select("a", "b", weight.alias("w"))
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _epoch(places: DataFrame, edges: DataFrame, rows: int, epoch: int, step: float, seed: int, pushes: int) -> DataFrame:
    """Places after one step; ``edges`` are ``a``, ``b`` and ``w``, the share of the weight of ``a``."""
    other = F.pmod(F.xxhash64("node", F.col("j"), F.lit(epoch), F.lit(seed)), F.lit(rows))
    pushed = places.select("node", F.explode(F.sequence(F.lit(1), F.lit(pushes))).alias("j")).select("node", other.alias("other"), F.lit(-BALANCE / pushes).alias("w"))
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").unionByName(pushed)
    there = places.select(F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = pairs.join(there, "other").join(places, "node")
    dx, dy = F.col("ox") - F.col("x"), F.col("oy") - F.col("y")
    far = dx * dx + dy * dy
    size = F.when(F.col("w") > 0, 2.0 / (1.0 + far)).otherwise(2.0 / ((0.1 + far) * (1.0 + far)))
    force = [F.sum(F.round(F.least(F.greatest(size * d, F.lit(-LARGEST)), F.lit(LARGEST)) * F.col("w") * UNIT).cast("long")) for d in (dx, dy)]
    moved = near.groupBy("node").agg(force[0].alias("fx"), force[1].alias("fy"))
    shift = lambda c, f: F.col(c) + step * F.coalesce(F.col(f), F.lit(0)) / UNIT
    return places.join(moved, "node", "left").select("node", shift("x", "fx").alias("x"), shift("y", "fy").alias("y"))


def neighbour_map(
    df: DataFrame, embedding: str = "z", key: str = "row_id", k: int = NEIGHBOURS, block: int = BLOCK, tables: int = TABLES,
    epochs: int = EPOCHS, pushes: int = PUSHES, seed: int = SEED,
) -> DataFrame:
    """The input columns plus ``x`` and ``y``."""
    spark = df.sparkSession
    ship_package(spark)
    vector = col(embedding).cast("array<double>")
    finite = F.coalesce(F.forall(vector, lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")), F.lit(False))), F.lit(False))
    lengths = df.where(finite & (F.size(vector) > 0)).groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None or lengths["count"] < 3:
        place = F.when(finite & (F.size(vector) > 0), F.lit(0.0))
        return df.withColumns({"x": place, "y": place})
    size, rows = lengths["size"], lengths["count"]
    usable = df.where(finite & (F.size(vector) == size)).select(col(key).alias("k"), vector.alias("v"))
    points = stage(number_rows(usable, "k", rows, seed).withColumnRenamed("number", "node"), "points")
    edges = edge_weights(neighbour_graph(points.select("node", "v"), size, rows, k, block, tables, seed))
    total = F.sum("w").over(Window.partitionBy("a"))
    # A row has few edges of its own, but may be the neighbour of many: its window is the hub's edges.
    edges = stage(edges.withColumn("w", F.col("w") / total), "edges")

    ready = points.withColumn("_v", array_to_vector("v"))
    plane = models.fit_embedding(ready, min(2, size), "_v", "_xy").transform(ready)
    xy = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.coalesce(F.get(models.vector_to_array(F.col("_xy")), i), F.lit(0.0)))
    start = plane.select("node", xy[0].alias("x"), xy[1].alias("y"))
    width, middle_x, middle_y = start.agg(F.sqrt((F.var_pop("x") + F.var_pop("y")) / 2), F.avg("x"), F.avg("y")).first()
    scale = SPREAD / width if width else 1.0
    # Whole steps of the fixed point from the start: sums of other tasks do not show.
    whole = lambda c, middle: F.round((F.col(c) - middle) * scale, 6).alias(c)
    path = scratch_path(spark, "places")
    start.select("node", whole("x", middle_x), whole("y", middle_y)).write.parquet(path)
    quick = steady(spark)
    links = quick.read.schema(edges.schema).parquet(*edges.inputFiles())
    schema = "node long, x double, y double"
    for epoch in range(epochs):
        step = 1.0 - epoch / epochs
        moved, before = _epoch(quick.read.schema(schema).parquet(path), links, rows, epoch, step, seed, pushes), path
        path = scratch_path(spark, "places")
        moved.write.parquet(path)
        release(spark, [before])
    record(path)
    found = points.select("k", "node").join(spark.read.schema(schema).parquet(path), "node").select(F.col("k").alias("_k"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    fits = finite & (F.size(vector) == size)
    joined = df.join(found, col(key).eqNullSafe(F.col("_k")), "left")
    return joined.select(*[col(c) for c in df.columns], F.when(fits, F.col("_x")).alias("x"), F.when(fits, F.col("_y")).alias("y"))
