"""From raw documents to a mixed training corpus: five stages, each over all its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it again for the next. All but the last return the columns
of ``docs``; the last adds the place of each document in the reading order.

Nulls, empty texts, ties, repeated rows, empty tables and clashing column names have the results
that the operators' modules state; columns besides ``doc_id``, ``text``, ``source`` and ``n_chars``
pass through. ``n_chars`` follows the text where it is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from cohortlens.llm.common import drop_path, ship_package, staged_path, table
from cohortlens.sources.staging import release, staged_paths


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labelled rows of ``documents``."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id, one without only if no other has any."""
    ship_package(spark)
    return simhash.keep_one(docs, words=3, distance=2, unkeyed_stay=False)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; documents of which nothing is left go.

    Documents that were blank before stay, as nothing of theirs was removed.
    """
    ship_package(spark)
    columns = docs.columns
    aside = {c: f"_kept_{c}" for c in ("n_removed", "removed_chars", "removed_spans") if c in columns}
    cut = line_dedup.remove_repeats(docs.withColumnsRenamed(aside), min_words=31, spread=20)
    cut = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.drop(*aside).withColumnsRenamed({v: k for k, v in aside.items()}).select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to 0.7 or more."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.7)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixed order (``orderBy("mix_position")`` reads them)."""
    ship_package(spark)
    return mixing.mix_sources(docs, block_rows=64, parts=200, temperature=0.5)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
]

#: SQL cannot express the trained network or the tiling; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the result is read from the last stage's table."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with staged_paths() as scratch:
            docs, path = staged_path(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # What the stage left on its way, and the result before it, are no longer read.
        scratch.remove(path)
        release(spark, scratch)
        if before is not None:
            drop_path(spark, before)
        before = path
    return docs
