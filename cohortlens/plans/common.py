"""Steps shared by the studies: preparing the cohort and validating a model on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cohortlens.functions.numbers import col
from cohortlens.operators import clean, evaluate, folds, models, profile
from cohortlens.operators.preprocess import Preprocessing, fit_preprocessing
from cohortlens.sources.bundle import ModelBundle
from cohortlens.sources.schema import ID_COLUMNS, require_columns
from cohortlens.sources.staging import release, stage, staged_paths

BINARY_CLASSES = ["Normal", "Cancer"]

# Rows a task of a fit reads at least: every round of a fit is a job, and a small cohort lies in many files.
FIT_TASK_ROWS = 5_000


@dataclass
class Cohort:
    """Complete, labelled rows with a fold, staged by fold, and how they were scaled."""

    table: DataFrame
    preprocessing: Preprocessing
    classes: list[str]
    k: int
    fit_scope: str
    raw_rows: int
    raw_columns: int
    n_rows: int
    missing: dict[str, int]
    class_rows: dict[str | None, tuple[int, int]]

    @property
    def features(self) -> list[str]:
        return self.preprocessing.features

    @cached_property
    def scaled(self) -> DataFrame:
        """Rows on the scale fitted over the whole cohort."""
        return self.table if self.fit_scope == "all" else self.preprocessing.transform(self.table)

    @property
    def rows(self) -> DataFrame:
        return clean.assemble(self.scaled, self.features)

    @property
    def fit_tasks(self) -> int:
        """Tasks a fit needs at most; a large cohort keeps the partitions of its scan."""
        return max(1, self.n_rows // FIT_TASK_ROWS)

    def quality_tables(self) -> dict[str, DataFrame]:
        """Unreadable values per feature, rows removed for them, and rows per class before and after."""
        spark = self.table.sparkSession
        removed, cells = self.raw_rows - self.n_rows, sum(self.missing.values())
        share = 100.0 * removed / self.raw_rows if self.raw_rows else None
        return {
            "missing": spark.createDataFrame(list(self.missing.items()), "column_name string, n_missing long"),
            "removal": spark.createDataFrame(
                [(self.raw_rows, removed, cells, self.n_rows, share)],
                "n_rows long, n_removed long, n_missing_cells long, n_kept long, pct_removed double",
            ),
            "class_counts": spark.createDataFrame(
                [(c, n, kept) for c, (n, kept) in self.class_rows.items()], "Condition string, n_rows long, n_kept long"
            ),
        }


@dataclass
class Study:
    """Every result table by name, the bundle of the final model, and the staged OOF rows.

    The tables read staged folders in the shared scratch space. ``release`` deletes those once the
    tables are written or no longer needed; as a context manager a study does so at the end.
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)
    bundle: ModelBundle | None = None
    fold_models: list = field(default_factory=list)
    staged: list[str] = field(default_factory=list)

    def release(self) -> None:
        if self.staged:
            release(next(iter(self.tables.values())).sparkSession, self.staged)

    def __enter__(self) -> Study:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def prepare_cohort(
    samples: DataFrame,
    task: str,
    k: int,
    key: str = "row_id",
    fit_scope: str = "all",
    seed: int = folds.SEED,
    with_medians: bool = True,
) -> Cohort:
    """Clean, transform, drop incomplete rows, label, split and stage.

    The cleaned text is staged once as numeric columns. One aggregation of it gives row counts,
    class counts, missing values and the smallest values, one the scaling; medians, which only
    scoring new samples needs, take several more and can be left out. The cleaned copy is deleted
    once the cohort is staged. ``fit_scope='all'`` scales with statistics of all rows before the
    split, ``'train'`` leaves that to every fold.
    """
    require_columns(samples.columns, [key, "Condition"])
    features = clean.feature_columns(samples.columns, use_age=task == "type")
    ids = [key, *[c for c in ID_COLUMNS if c in samples.columns]]
    with staged_paths() as scratch:
        cleaned = stage(clean.clean_numeric(samples.select(*[col(c) for c in [*ids, *features]]), features), "cleaned")
    # One row per class.
    found = profile.class_summary(cleaned, features).collect()
    lowest = {c: min((r["lowest"][i] for r in found if r["lowest"][i] is not None), default=None) for i, c in enumerate(features)}
    n_rows = sum(r["n_complete"] for r in found)
    prep = fit_preprocessing(cleaned, features, with_medians=with_medians, lowest=lowest)
    complete = clean.drop_missing(cleaned, features)
    values = prep.transform(complete) if fit_scope == "all" else complete
    if task == "binary":
        labelled, classes = clean.binary_label(values, out="label"), list(BINARY_CLASSES)
    else:
        classes = sorted(r["Condition"] for r in found if r["n_complete"] and r["Condition"] is not None)
        labelled = clean.encode_labels(values, clean.label_codes(classes, "Condition"))
    split = folds.stratified_folds(labelled, "label", key, k, seed, rows=n_rows)
    cohort = Cohort(
        stage(split, "cohort", partition_by="fold"),
        prep,
        classes,
        k,
        fit_scope,
        sum(r["n_rows"] for r in found),
        len(samples.columns),
        n_rows,
        {c: sum(r["n_missing"][i] for r in found) for i, c in enumerate(features)},
        {r["Condition"]: (r["n_rows"], r["n_complete"]) for r in sorted(found, key=lambda r: r["Condition"] or "")},
    )
    release(samples.sparkSession, scratch)
    return cohort


def validate(
    cohort: Cohort, fit: models.Fit, score: models.Score, keep: Sequence[str], parallelism: int = 2, fitted: Sequence | None = None
) -> models.CrossValidation:
    """Out-of-fold rows of a cohort, staged, with the id columns that reports need.

    ``fitted`` are the folds' models where one pass over the cohort has fitted them together.
    """
    if fitted is not None:
        result = models.score_folds(cohort.rows, fitted, score)
    elif cohort.fit_scope == "all":
        result = models.cross_validate(cohort.rows, fit, score, cohort.k, parallelism, cohort.fit_tasks)
    else:

        def fit_with_scale(train: DataFrame):
            prep = fit_preprocessing(train, cohort.features, with_medians=False)
            return prep, fit(clean.assemble(prep.transform(train), cohort.features))

        def score_with_scale(fitted, test: DataFrame) -> DataFrame:
            prep, model = fitted
            return score(model, clean.assemble(prep.transform(test), cohort.features))

        result = models.cross_validate(cohort.table, fit_with_scale, score_with_scale, cohort.k, parallelism, cohort.fit_tasks)
    outputs = [c for c in ("prediction", "score", "probs", "z") if c in result.oof.columns]
    present = [c for c in keep if c in result.oof.columns]
    pooled = result.oof.select(*[col(c) for c in [*present, "fold", "label", *outputs]])
    return models.CrossValidation(stage(pooled, "oof"), result.models)


def accuracy_tables(oof: DataFrame) -> dict[str, DataFrame]:
    per_fold = evaluate.accuracy_by_fold(oof)
    return {"accuracy_by_fold": per_fold, "accuracy": evaluate.mean_std(per_fold, "accuracy")}


def cohort_facts(spark: SparkSession, cohort: Cohort, **settings: float) -> DataFrame:
    from cohortlens.operators.report import facts

    shape = {
        "original rows": cohort.raw_rows,
        "original columns": cohort.raw_columns,
        "final rows": cohort.n_rows,
        "features": len(cohort.features),
        "classes": len(cohort.classes),
    }
    return facts(spark, "dataset", {**shape, **settings})
