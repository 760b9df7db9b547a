"""Columns of the sample table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

# The assay panel, in model order. Names are exact, units included.
ASSAY_COLUMNS = (
    "AFP (pg/ml)",
    "Angiopoietin-2 (pg/ml)",
    "AXL (pg/ml)",
    "CA-125 (U/ml)",
    "CA 15-3 (U/ml)",
    "CA19-9 (U/ml)",
    "CD44 (ng/ml)",
    "CEA (pg/ml)",
    "CYFRA 21-1 (pg/ml)",
    "DKK1 (ng/ml)",
    "Endoglin (pg/ml)",
    "FGF2 (pg/ml)",
    "Follistatin (pg/ml)",
    "Galectin-3 (ng/ml)",
    "G-CSF (pg/ml)",
    "GDF15 (ng/ml)",
    "HE4 (pg/ml)",
    "HGF (pg/ml)",
    "IL-6 (pg/ml)",
    "IL-8 (pg/ml)",
    "Kallikrein-6 (pg/ml)",
    "Leptin (pg/ml)",
    "Mesothelin (ng/ml)",
    "Midkine (pg/ml)",
    "Myeloperoxidase (ng/ml)",
    "NSE (ng/ml)",
    "OPG (ng/ml)",
    "OPN (pg/ml)",
    "PAR (pg/ml)",
    "Prolactin (pg/ml)",
    "sEGFR (pg/ml)",
    "sFas (pg/ml)",
    "SHBG (nM)",
    "sHER2/sEGFR2/sErbB2 (pg/ml)",
    "sPECAM-1 (pg/ml)",
    "TGFa (pg/ml)",
    "Thrombospondin-2 (pg/ml)",
    "TIMP-1 (pg/ml)",
    "TIMP-2 (pg/ml)",
)

# Columns that are never cleaned or scaled.
ID_COLUMNS = ("PatientID", "SampleID", "Condition", "Stage")

# Substrings that mark a label column, and demographic column names.
LABEL_HINTS = ("cancer", "type", "condition", "diagnosis")
DEMOGRAPHIC_NAMES = ("age", "gender", "sex", "stage", "grade")


def sample_schema(columns: Sequence[str]) -> T.StructType:
    """Schema for a raw sample file: ``row_id`` is a bigint, all else text (values may hold ``*``)."""
    return T.StructType(
        [T.StructField(c, T.LongType() if c == "row_id" else T.StringType()) for c in columns]
    )


def require_columns(available: Sequence[str], required: Sequence[str]) -> None:
    missing = [c for c in required if c not in set(available)]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def find_label_column(columns: Sequence[str], exact: str = "condition", hints: Sequence[str] = LABEL_HINTS) -> str:
    """The exact name if present, else the first column whose lower-case name holds a hint."""
    if exact in columns:
        return exact
    for name in columns:
        if any(h in name.lower() for h in hints):
            return name
    raise ValueError("no label column found")
