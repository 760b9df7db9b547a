"""Cohort profile: the tables behind the distribution figures."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens.operators import profile
from cohortlens.sources.schema import find_label_column


def profile_cohort(samples: DataFrame) -> dict[str, DataFrame]:
    """Counts and shares of the label, cross-tabs with demographics, stage shares by type.

    Works on the raw table: cleaning would turn text demographics into missing values. Cross-tabs are
    long, one row per pair that occurs: nothing bounds the number of label values.
    """
    label = find_label_column(samples.columns)
    demographics = profile.demographic_columns(samples)
    tables = {
        "shape": profile.shape(samples),
        "label_counts": profile.value_counts(samples, label),
        "label_percentages": profile.value_percentages(samples, label),
        "demographic_columns": demographics,
    }
    for row in demographics.collect():
        tables[f"{label} by {row['column_name']}"] = profile.crosstab_counts(samples, label, row["column_name"])
    stage = profile.stage_column(samples)
    if stage:
        tables["stage_share_by_label"] = profile.crosstab_share(samples, stage, label)
    return tables
