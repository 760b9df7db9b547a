"""Seeded hashes of a row key: shuffles that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.numbers import col


def keyed_hash(key: str, seed: int) -> Column:
    """32 hex digits that order rows at random, the same on every run and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string")))
