"""Stratified folds, class weights and keyed samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.keys import keyed_hash
from cohortlens.functions.numbers import col, ratio
from cohortlens.operators.lookup import lookup_join

# Fold counts and seed.
BINARY_FOLDS = 10
TYPE_TREE_FOLDS = 5
SEED = 42

PREFIX_ROWS = 10_000


def stratified_folds(
    df: DataFrame, label: str, key: str, k: int = BINARY_FOLDS, seed: int = SEED, hash_digits: int | None = None, rows: int | None = None
) -> DataFrame:
    """Add ``fold``: a shuffled split whose sizes differ by at most one, overall and per class.

    Fold = (rows of earlier classes + rank within the class in keyed-hash order) mod k.
    Ranking a class in one window would put a dominant class in one task, so rows are
    ranked inside (class, hash prefix) and the prefix starts come from a running sum over
    the counts. Prefixes split any class evenly because ``key`` is unique. Their length follows the
    number of ``rows`` (counted here if not given); the split does not depend on it.
    """
    if hash_digits is None:
        hash_digits = digits_for(df.select(col(key)).count() if rows is None else rows)
    # Join keys that are never NULL: the join then matches the window's partitioning, so the
    # wide rows are shuffled once, and no null filter repeats the hash in the scan.
    class_key = F.coalesce(F.concat(F.lit("="), col(label).cast("string")), F.lit(""))
    hashed = _with_prefix(df.withColumn("_class", class_key), key, seed, hash_digits)
    place = _numbered(hashed, _prefix_starts(hashed, label), key)
    return place.select(*[col(c) for c in df.columns if c != "fold"], (F.col("_place") % k).cast("int").alias("fold"))


def number_rows(df: DataFrame, key: str, rows: int, seed: int = SEED) -> DataFrame:
    """Add ``number``: 0, 1, ... in the order of a hash of the unique ``key``; ``rows`` is their count."""
    hashed = _with_prefix(df.withColumn("_class", F.lit("")).withColumn("_all", F.lit(0)), key, seed, digits_for(rows))
    place = _numbered(hashed, _prefix_starts(hashed, "_all"), key)
    return place.select(*[col(c) for c in df.columns], F.col("_place").alias("number"))


def _with_prefix(df: DataFrame, key: str, seed: int, digits: int) -> DataFrame:
    hashed = df.withColumn("_hash", keyed_hash(key, seed))
    return hashed.withColumn("_prefix", F.coalesce(F.substring("_hash", 1, digits), F.lit("")))


def _numbered(hashed: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    in_prefix = Window.partitionBy("_class", "_prefix").orderBy("_hash", col(key))
    ranked = hashed.withColumn("_rank", F.row_number().over(in_prefix) - 1)
    return ranked.join(starts, ["_class", "_prefix"]).withColumn("_place", F.col("_start") + F.col("_rank"))


def digits_for(rows: int) -> int:
    """Hex digits of the prefixes, so that one holds some ten thousand rows; four at least."""
    return max(4, math.ceil(math.log(max(rows / PREFIX_ROWS, 1), 16)))


def _prefix_starts(hashed: DataFrame, label: str) -> DataFrame:
    """Global start position of every (class, prefix): at most 16^digits rows per class."""
    counts = hashed.groupBy("_class", col(label).alias("_label"), "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_class").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    in_class = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    per_class = counts.groupBy("_class", "_label").agg(F.sum("_n").alias("_total"))
    # One row per class, so the single-task window is over a handful of rows.
    smaller = (
        Window.partitionBy(F.lit(0))
        .orderBy(F.col("_label").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    class_starts = per_class.select("_class", F.coalesce(F.sum("_total").over(smaller), F.lit(0)).alias("_offset"))
    start = (F.col("_offset") + F.col("_before")).alias("_start")
    return in_class.join(class_starts, "_class").select("_class", "_prefix", start)


def train_split(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold") != fold)


def test_split(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold") == fold)


def fold_class_distribution(df: DataFrame, label: str = "label", k: int = BINARY_FOLDS) -> DataFrame:
    """Class counts of every training part: class total minus the count in the held-out fold."""
    held_out = df.groupBy(col(label), "fold").agg(F.count(F.lit(1)).alias("held_out"))
    totals = held_out.groupBy(col(label)).agg(F.sum("held_out").alias("total"))
    grid = totals.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    train = F.col("total") - F.coalesce(F.col("held_out"), F.lit(0))
    return (
        grid.join(held_out, [label, "fold"], "left")
        .select("fold", col(label), train.alias("train_rows"))
        .filter(F.col("train_rows") > 0)
    )


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """One row per class: rows / (classes * rows of the class)."""
    counts = df.filter(col(label).isNotNull()).groupBy(col(label)).agg(F.count(F.lit(1)).alias("n"))
    # Windows over one row per class.
    everything = Window.partitionBy(F.lit(0))
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return counts.select(col(label), weight.alias("weight"))


def attach_weights(df: DataFrame, weights: DataFrame, label: str = "label", salts: int = 1) -> DataFrame:
    return lookup_join(df, weights, [label], "left", salts)


def positive_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: negatives / positives over all rows."""
    return df.agg(ratio(F.count_if(col(label) == 0), F.count_if(col(label) == 1)).alias("pos_weight"))


def positive_weight_column(weight: float, label: str = "label") -> Column:
    return F.when(col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0))


def sample_n(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement (all rows if fewer), the same rows on every run.

    Each task keeps its own best ``n``, so no full sort happens.
    """
    return df.orderBy(keyed_hash(key, seed), col(key)).limit(n)
