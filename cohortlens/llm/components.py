"""Connected components by alternating large and small stars.

Links live in tables only: every round is two joins and an aggregation, written to the shared
folder, so neither a hub nor a large component has to fit in one task or the driver. Rounds grow
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import drop_path, staged_path


def _large_star(links: DataFrame, paths: list[str]) -> DataFrame:
    """Larger neighbours of each node move to the smallest neighbour (or the node itself)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # The minima are written first: the join then shuffles both sides itself and a hub can be split.
    least, path = staged_path(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "least")
    paths.append(path)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame, paths: list[str]) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest of them."""
    least, path = staged_path(links.groupBy("a").agg(F.min("b").alias("least")), "least")
    paths.append(path)
    moved = links.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of ``links`` (columns ``a``, ``b``, longs) but the roots.

    Loops and repeated links are ignored; nodes without a link to another node are not returned either.
    """
    spark = links.sparkSession
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, path = staged_path(ordered, "links")
    before = None
    while True:
        paths = [path]
        found = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == before or not found[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = found
        large, large_path = staged_path(_large_star(current, paths).distinct(), "links")
        current, path = staged_path(_small_star(large, paths), "links")
        for old in [*paths, large_path]:
            drop_path(spark, old)
