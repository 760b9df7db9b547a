"""Readers, writers, saved bundles and staged tables."""
