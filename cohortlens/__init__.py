"""Cohort classification analytics on Spark DataFrames.

Every operator takes and returns DataFrames keyed by a stable row id; fitted
steps return small parameter objects or Spark ML models.
"""
