"""Feature attributions: sampled Shapley values and the tables behind their figures."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.numbers import col
from cohortlens.operators.folds import SEED, number_rows
from cohortlens.operators.lookup import lookup_join
from cohortlens.operators.ranking import WATERFALL_FEATURES
from cohortlens.sources.staging import stage

# Attribution budget and number of features shown one by one.
BACKGROUND_ROWS = 100
EXPLAINED_ROWS = 200
TOP_SHOWN = 5

# Switched copies scored by one task, on average.
COPIES_PER_TASK = 1_000_000


def shapley_attributions(
    df: DataFrame,
    features: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    background: DataFrame,
    key: str = "row_id",
    rounds: int = 1,
    seed: int = SEED,
) -> DataFrame:
    """Contribution of every feature to every class score of every row of ``df``.

    Feature orders are sampled: a row meets every background row ``rounds`` times, each
    time with its own order. Along an order the features switch one by one from the
    background value to the row's value, and a feature is credited with the change in
    score when it switches. All switched rows are scored in one pass; each scored row
    adds to the feature just switched on and subtracts from the next one, so the result is
    a single map-side-combined aggregation.

    ``score`` maps a frame with an ``x array<double>`` column to one that adds
    ``scores array<double>`` (one per class). Output: ``row_id, class, feature, value, phi,
    base``; per row and class ``base + sum(phi)`` is the score of the row. Neither the rows nor
    the background have a largest size; the work is their product.
    """
    d, tasks = len(features), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered, n_background = _number_background(background, features, key)
    values = F.array(*[col(f).cast("double") for f in features])
    rows = df.select(col(key).alias("row_id"), values.alias("row_x"))
    n_orders = rounds * n_background
    if n_orders == 0:
        raise ValueError("the background has no rows")
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_orders - 1))))
    # A sample arrives in one small partition; scoring its many switched copies must not stay there.
    copies = df.count() * n_orders * (d + 1)
    drawn = drawn.repartition(max(tasks, math.ceil(copies / COPIES_PER_TASK)), "row_id", "draw")
    paired = lookup_join(drawn.withColumn("b", F.col("draw") % n_background), numbered, ["b"], "inner")

    positions = F.sequence(F.lit(0), F.lit(d - 1))
    hashed = F.transform(positions, lambda j: F.struct(F.xxhash64(F.lit(seed), F.col("row_id"), F.col("draw"), j).alias("h"), j.alias("j")))
    ordered = paired.withColumn("order", F.transform(F.array_sort(hashed), lambda s: s["j"]))
    # The step at which each feature switches, once per pair: the inverse of the order.
    switches = F.array_sort(F.transform("order", lambda j, i: F.struct(j.alias("j"), (i + 1).alias("at"))))
    placed = ordered.withColumn("place", F.transform(switches, lambda s: s["at"]))
    steps = placed.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    switched = F.transform(
        positions,
        lambda j: F.when(F.get("place", j) <= F.col("step"), F.get("row_x", j)).otherwise(F.get("background_x", j)),
    )
    # Step t has t features switched on: it credits the t-th and is the base of the next. Only these
    # two go along with a copy, not the rows and orders it was made from.
    on, off = F.get("order", F.col("step") - 1), F.get("order", F.col("step"))
    slim = steps.select(
        "row_id", switched.alias("x"),
        on.alias("on"), F.get("row_x", on).alias("on_value"), off.alias("off"), F.get("row_x", off).alias("off_value"),
    )
    gained = F.struct(F.col("on").alias("j"), F.col("on_value").alias("value"), F.lit(1.0).alias("sign"))
    spent = F.struct(F.col("off").alias("j"), F.col("off_value").alias("value"), F.lit(-1.0).alias("sign"))
    signed = score(slim).select("row_id", "scores", F.inline(F.filter(F.array(gained, spent), lambda s: s["j"].isNotNull())))
    per_class = signed.select("row_id", "j", "value", "sign", F.posexplode("scores").alias("class", "f"))
    summed = per_class.groupBy("row_id", "class", "j").agg(F.first("value").alias("value"), F.sum(F.col("sign") * F.col("f")).alias("total"))
    # The base is the mean score of the background: one row per class.
    start = score(numbered.select(F.col("background_x").alias("x")))
    base = start.select(F.posexplode("scores").alias("class", "f")).groupBy("class").agg(F.avg("f").alias("base"))
    names = F.array(*[F.lit(f) for f in features])
    return lookup_join(summed, base, ["class"], "inner").select(
        "row_id",
        "class",
        F.get(names, F.col("j")).alias("feature"),
        "value",
        (F.col("total") / n_orders).alias("phi"),
        "base",
    )


def _number_background(background: DataFrame, features: Sequence[str], key: str) -> tuple[DataFrame, int]:
    """Background rows as ``(b, background_x)`` with b = 0, 1, ..., and how many they are.

    Rows are numbered in the order of a hash of their key, as folds are: ranks inside hash prefixes
    plus prefix starts, so no task holds them all.
    """
    values = F.array(*[col(f).cast("double") for f in features]).alias("background_x")
    rows = stage(background.select(col(key).alias("_key"), values), "background")
    n = rows.count()
    return number_rows(rows, "_key", n).select(F.col("number").alias("b"), "background_x"), n


def shap_ranking(attributions: DataFrame) -> DataFrame:
    """Features by mean absolute attribution over samples and classes."""
    size = F.avg(F.abs(F.col("phi"))).alias("importance")
    return attributions.groupBy("feature").agg(size).orderBy(F.desc("importance"), "feature")


def class_shap_ranking(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per class and feature."""
    return attributions.groupBy("class", "feature").agg(F.avg(F.abs(F.col("phi"))).alias("importance"))


def waterfall_rows(attributions: DataFrame, row_id, n: int = WATERFALL_FEATURES) -> DataFrame:
    """The largest contributions of one sample, the rest summed as ``other``.

    Columns ``(rank, feature, value, phi, base)``; with more than ``n`` features the first
    ``n - 1`` are shown and the remainder takes the last place.
    """
    one = attributions.filter(F.col("row_id") == row_id)
    # Windows over the features of a single sample.
    everything = Window.partitionBy("row_id")
    placed = one.withColumn(
        "place", F.row_number().over(everything.orderBy(F.desc(F.abs(F.col("phi"))), "feature"))
    ).withColumn("size", F.count(F.lit(1)).over(everything))
    shown = (F.col("size") <= n) | (F.col("place") < n)
    labelled = placed.select(
        F.when(shown, F.col("place")).otherwise(F.lit(n)).alias("rank"),
        F.when(shown, F.col("feature")).otherwise(F.lit("other")).alias("feature"),
        F.when(shown, F.col("value")).alias("value"),
        "phi",
        "base",
    )
    return labelled.groupBy("rank", "feature").agg(
        F.first("value", ignorenulls=True).alias("value"), F.sum("phi").alias("phi"), F.first("base").alias("base")
    ).orderBy("rank")


def dependence_rows(attributions: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, row_id, value, phi)`` pairs for the features shown one by one."""
    return attributions.filter(F.col("feature").isin(list(features))).select("feature", "row_id", "value", "phi")
