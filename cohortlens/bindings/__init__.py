"""Operators bound to the test tables, each with the SQL that must give the same rows."""

from cohortlens.bindings import curves, evaluation, folds, latent, models, preparation, profiling, storage  # noqa: F401
from cohortlens.bindings.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
