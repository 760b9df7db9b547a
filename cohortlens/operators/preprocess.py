"""The fitted chain from raw text values to a scaled feature vector."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortlens.operators import clean, scale

# Fixed value: features the type models leave on their own scale.
LOG2_EXCLUDED = ("Age",)


@dataclass(frozen=True)
class Preprocessing:
    """Everything needed to bring a new row to the scale the model was trained on.

    A value below the lowest one fitted has no place on the log scale of the model. It counts as
    the lowest fitted value, so an extremely low measurement stays the lowest, and a row that was
    not fitted is never lost. Missing values are another matter: they stay missing or are filled.
    """

    features: list[str]
    offsets: dict[str, float]
    medians: dict[str, float | None]
    scaling: scale.Scaling
    lowest: dict[str, float | None]

    def transform(self, df: DataFrame, apply_log2: bool = True) -> DataFrame:
        """Log2 and standard scaling of cleaned rows; missing values stay missing."""
        logged = scale.apply_log2(df, self.offsets, self.lowest) if apply_log2 else df
        return scale.apply_standardize(logged, self.scaling)

    def count_clamped(self, df: DataFrame, out: str = "n_clamped") -> DataFrame:
        """Add how many cleaned values of a row lie below the fitted range."""
        return scale.count_below(df, self.lowest, out)

    def transform_filled(
        self, df: DataFrame, fills: Mapping[str, float | None] | None = None, apply_log2: bool = True
    ) -> DataFrame:
        """As ``transform``, with missing values filled.

        ``fills`` are on the raw scale; the training medians are used without them.
        """
        raw = self.medians if fills is None else fills
        logged = scale.apply_log2(df, self.offsets, self.lowest) if apply_log2 else df
        ready = {c: self._logged(c, v) if apply_log2 else v for c, v in raw.items() if v is not None}
        return scale.apply_standardize(scale.fill_missing(logged, ready), self.scaling)

    def _logged(self, column: str, value: float) -> float:
        if column not in self.offsets:
            return value
        low = self.lowest.get(column)
        return math.log2((value if low is None else max(value, low)) + self.offsets[column])


def fit_preprocessing(
    cleaned: DataFrame,
    features: Sequence[str],
    exclude: Sequence[str] = LOG2_EXCLUDED,
    with_medians: bool = True,
    lowest: Mapping[str, float | None] | None = None,
) -> Preprocessing:
    """Offsets over all cleaned rows, then scaling and medians over the complete rows.

    ``lowest`` gives the smallest values of the columns if they are known already.
    """
    names = list(features)
    logged = [c for c in names if c not in exclude]
    low = scale.fit_lowest(cleaned, logged) if lowest is None else {c: lowest[c] for c in logged}
    offsets = scale.offsets_of(low)
    complete = clean.drop_missing(cleaned, names)
    scaling = scale.fit_standardize(scale.apply_log2(complete, offsets), names)
    medians = scale.fit_medians(complete, names) if with_medians else {}
    return Preprocessing(names, offsets, medians, scaling, low)
