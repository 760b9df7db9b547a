"""Joining a table of one row per key to a large one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import col


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = 1) -> DataFrame:
    """Equi-join a table of one row per key onto ``big``; nothing runs until the result is used.

    The adaptive planner broadcasts ``small`` when its measured size allows, and splits hot keys
    otherwise. With ``salts`` above 1 the lookup is repeated once per salt and the join is on
    (key, salt), for keys that are known to hold much of ``big``.
    """
    if salts == 1:
        return _join(big, small, on, how)
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*[col(c) for c in big.columns]), F.lit(salts)).cast("int")
    return _join(big.withColumn("_salt", salt), salted_small, [*on, "_salt"], how).drop("_salt")


def _join(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Null-safe equi-join that keeps the columns of ``big`` plus the looked-up values."""
    renamed = small.select(
        *[col(c).alias(f"_on_{c}") for c in on],
        *[col(c) for c in small.columns if c not in on],
    )
    matches = reduce(lambda a, b: a & b, [col(c).eqNullSafe(col(f"_on_{c}")) for c in on])
    return big.join(renamed, matches, how).drop(*[f"_on_{c}" for c in on])
