"""Whole studies: from a raw sample table to every report and a saved bundle."""
