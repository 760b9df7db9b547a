"""Scoring of arriving samples with the batch functions."""
