"""Whole studies, bundles, sinks and streaming on a cohort derived from the test tables."""

from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohortlens.bindings.views import assay_cohort
from cohortlens.operators import clean, models, scoring
from cohortlens.operators.preprocess import fit_preprocessing
from cohortlens.plans.binary import run_binary
from cohortlens.plans.common import prepare_cohort, validate
from cohortlens.plans.latent import run_latent
from cohortlens.plans.profiling import profile_cohort
from cohortlens.plans.types import run_type
from cohortlens.sources import sinks
from cohortlens.sources.bundle import load_bundle, save_bundle
from cohortlens.sources.samples import read_samples
from cohortlens.sources.schema import ASSAY_COLUMNS, find_label_column, require_columns, sample_schema
from cohortlens.streaming.scoring import read_sample_stream, score_stream, write_score_stream


@pytest.fixture(scope="module")
def samples(spark):
    return assay_cohort(spark, SMALL)


@pytest.fixture(scope="module")
def binary_study(samples):
    return run_binary(samples, k=2, rounds=2)


def test_cohort_is_scaled_and_split(spark, samples):
    gap = samples.withColumn("AFP (pg/ml)", F.when(F.col("row_id") == 0, "n/a").otherwise(F.col("AFP (pg/ml)")))
    cohort = prepare_cohort(gap, "binary", k=5)
    assert cohort.n_rows == cohort.raw_rows - 1 and len(cohort.features) == len(ASSAY_COLUMNS) + 6
    stats = cohort.scaled.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cohort.features)]).first()
    assert max(abs(m) for m in stats) < 1e-9
    spread = cohort.scaled.agg(*[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(cohort.features)]).first()
    assert max(abs(s - 1) for s in spread) < 1e-9
    sizes = [r["count"] for r in cohort.table.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_binary_study(binary_study, samples):
    tables = binary_study.tables
    assert tables["oof"].count() == samples.count() == tables["oof"].select("row_id").distinct().count()
    assert {r["Stage"] for r in tables["sensitivity_by_stage"].collect()} == {"I", "II", "III"}
    cells = tables["confusion_cells"].first()
    assert sum(cells) == samples.count()
    assert tables["importance"].agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    points = tables["roc_curve"].orderBy(F.desc("threshold"), "fpr").collect()
    assert tuple(points[-1])[1:] == (1.0, 1.0) and all(a["tpr"] <= b["tpr"] for a, b in zip(points, points[1:]))
    sections = {r["section"] for r in tables["summary"].select("section").distinct().collect()}
    assert {"dataset", "accuracy", "auc", "confusion", "sensitivity by stage", "report"} <= sections


def test_bundle_roundtrip_and_streaming(spark, binary_study, samples, tmp_path):
    path = str(tmp_path / "bundle")
    save_bundle(binary_study.bundle, path, spark)
    bundle = load_bundle(path, spark)
    assert bundle.preprocessing == binary_study.bundle.preprocessing and bundle.classes == ["Normal", "Cancer"]
    before = scoring.score_risk(samples, binary_study.bundle).orderBy("row_id").collect()
    assert before == scoring.score_risk(samples, bundle).orderBy("row_id").collect()

    samples.coalesce(2).write.option("header", True).csv(str(tmp_path / "in"))
    stream = read_sample_stream(spark, str(tmp_path / "in"), sample_schema(samples.columns))
    query = write_score_stream(score_stream(stream, bundle), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    key = ["row_id", "prediction", "cancer_probability", "predicted_class"]
    assert streamed.select(*key).orderBy("row_id").collect() == scoring.score_risk(samples, bundle).select(*key).orderBy("row_id").collect()


def test_scoring_matches_the_training_scale(binary_study, samples):
    """A complete row is scored on exactly the scale it was trained on."""
    prep = binary_study.bundle.preprocessing
    cleaned = clean.clean_numeric(samples, prep.features)
    trained = prep.transform(cleaned).select("row_id", *[f"`{c}`" for c in prep.features])
    scored = prep.transform_filled(cleaned).select("row_id", *[f"`{c}`" for c in prep.features])
    assert trained.exceptAll(scored).count() == 0


def test_missing_values_take_the_chosen_median(spark, binary_study, samples):
    prep = binary_study.bundle.preprocessing
    name = prep.features[0]
    gap = clean.clean_numeric(samples.withColumn(name, F.lit("n/a")), prep.features)
    filled = prep.transform_filled(gap).select(F.col(f"`{name}`")).distinct().collect()
    direct = prep.transform(gap.withColumn(name, F.lit(prep.medians[name]))).select(F.col(f"`{name}`")).distinct().collect()
    assert len(filled) == 1 and filled[0][0] == pytest.approx(direct[0][0])
    raw = prep.transform_filled(gap, {name: 3.0}, apply_log2=False).select(F.col(f"`{name}`")).first()[0]
    assert raw == pytest.approx((3.0 - prep.scaling.means[name]) / prep.scaling.stds[name])


def test_missing_feature_is_refused(binary_study, samples):
    with pytest.raises(ValueError):
        scoring.score_risk(samples.drop("AFP (pg/ml)"), binary_study.bundle)


def test_type_study_with_weights(spark, samples, tmp_path):
    study = run_type(samples, weighted=True, k=2, rounds=2)
    n = samples.filter("Condition <> 'Normal'").count()
    tables = study.tables
    assert study.bundle.classes == ["Breast", "Lung", "Ovary"] and set(study.bundle.class_weights) == set(study.bundle.classes)
    assert tables["oof"].count() == n and "Age" in study.bundle.preprocessing.features
    assert "Age" not in study.bundle.preprocessing.offsets
    assert tables["accuracy_by_class"].agg(F.sum("total")).first()[0] == n
    named = {r["class"] for r in tables["classification_report"].collect()}
    assert {"Breast", "Lung", "Ovary", "accuracy", "macro avg", "weighted avg"} == named
    top = scoring.score_types(samples, study.bundle).first()
    folder, columns = str(tmp_path / "in"), samples.columns
    samples.coalesce(1).write.option("header", True).csv(folder)
    scored = score_stream(read_sample_stream(spark, folder, sample_schema(columns)), study.bundle)
    write_score_stream(scored, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == samples.count()
    assert len(top["top_labels"]) == 2 and top["top_probabilities"][0] >= top["top_probabilities"][1]


@pytest.mark.parametrize("task", ["binary", "type"])
def test_latent_study(samples, task):
    study = run_latent(samples, task, k=2, iterations=3, background_rows=3, explained_rows=4, fit_scope="train")
    tables = study.tables
    assert all(len(r["z"]) == 8 for r in tables["oof"].select("z").take(5))
    assert tables["latent_map"].count() == tables["oof"].count()
    assert {r["fold"] for r in tables["loss_curve"].collect()} == {0, 1}
    d = len(study.bundle.preprocessing.features)
    classes = 1 if task == "binary" else 3
    assert tables["attributions"].count() == 4 * d * classes
    assert tables["top_features"].count() == 20
    assert any(n.startswith("waterfall") for n in tables) == (task == "binary")
    assert ("class_shap_ranking" in tables) == (task == "type")


@pytest.mark.parametrize("task, scope", [("binary", "all"), ("type", "all"), ("type", "train")])
def test_joint_study(spark, samples, task, scope, tmp_path):
    study = run_latent(samples, task, k=2, iterations=3, background_rows=2, explained_rows=2, fit_scope=scope, model="joint", attribution="kernel")
    tables, d = study.tables, len(study.bundle.preprocessing.features)
    assert all(len(r["z"]) == 8 for r in tables["oof"].select("z").take(5))
    curves = tables["loss_curves"].collect()
    weight = 20.0 if task == "binary" else 200.0
    assert {(r["fold"], r["epoch"]) for r in curves} == {(f, e) for f in (0, 1) for e in range(3)}
    assert all(r["loss"] == pytest.approx(r["recon"] + 5 * r["kl"] + weight * r["cls"]) for r in curves)
    assert study.bundle.model.settings.lambda_class == 20.0
    assert tables["latent_map"].count() == tables["oof"].count()
    assert tables["attributions"].count() == 2 * d * (1 if task == "binary" else 3)
    if scope == "all":
        score = scoring.score_risk if task == "binary" else scoring.score_types
        save_bundle(study.bundle, str(tmp_path / "bundle"), spark)
        before, after = (score(samples, b).orderBy("row_id").collect() for b in (study.bundle, load_bundle(str(tmp_path / "bundle"), spark)))
        assert before == after and len(before) == samples.count()
    study.release()


def test_unknown_latent_models(samples):
    for wrong in ({"model": "deep"}, {"attribution": "tree"}, {"layout": "circle"}):
        with pytest.raises(ValueError):
            run_latent(samples, **wrong)


def test_scale_fitted_per_fold_differs_from_whole(samples):
    whole = prepare_cohort(samples, "binary", k=2)
    per_fold = prepare_cohort(samples, "binary", k=2, fit_scope="train")
    cv = validate(per_fold, lambda t: models.fit_boosted_binary(t, rounds=1), models.score_binary, ["row_id"])
    assert cv.oof.count() == whole.n_rows
    a, b = (prep.scaling.means[whole.features[0]] for prep, _ in cv.models)
    assert a != b and whole.preprocessing.scaling.means[whole.features[0]] not in (a, b)


def test_profile_uses_the_raw_table(samples):
    tables = profile_cohort(samples)
    assert tables["shape"].first()["n_rows"] == samples.count()
    assert "Condition by Stage" in tables and "stage_share_by_label" in tables


def test_reading_rules(spark, samples, tmp_path):
    samples.limit(20).write.parquet(str(tmp_path / "all"))
    got = read_samples(spark, str(tmp_path / "absent"), fallback=str(tmp_path / "all"))
    assert got.filter("Condition = 'Normal'").count() == 0
    with pytest.raises(Exception):
        read_samples(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError):
        read_samples(spark, str(tmp_path / "all"), required=["Nope"])
    assert find_label_column(["a", "Cancer Stage", "Tumor type"]) == "Cancer Stage"
    assert find_label_column(["Type", "condition"]) == "condition"
    with pytest.raises(ValueError):
        find_label_column(["a"])
    require_columns(["a"], ["a"])


def test_report_files(spark, tmp_path):
    importance = spark.createDataFrame([("b", 0.25), ("a", 0.75)], "feature string, importance double")
    sinks.write_importance(importance, str(tmp_path / "imp"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "imp")).collect()]
    assert lines == ["Feature,Importance", "a,0.75", "b,0.25"]
    sinks.write_top_features(importance, str(tmp_path / "top"), n=1)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "top")).collect()]
    assert lines == ["Rank\tFeature\tSHAP Importance", "1\ta\t0.750000"]


def test_released_study_leaves_nothing_staged(spark, samples, tmp_path):
    from pathlib import Path

    from cohortlens.plans.writing import write_study

    with run_binary(samples, k=2, rounds=1) as study:
        staged = [Path(p.removeprefix("file:")) for p in study.staged]
        names = {p.name.rsplit("-", 1)[0] for p in staged}
        assert {"cleaned", "cohort", "oof", "ladder", "fold-ladder"} <= names
        # The cleaned copy went as soon as the cohort was staged.
        assert [p.name for p in staged if not p.exists()] == [p.name for p in staged if p.name.startswith("cleaned")]
        parts = write_study(study, str(tmp_path / "study"))
    assert not any(p.exists() for p in staged) and study.staged == []
    header = spark.read.option("header", True).csv(parts["preprocessed"]).columns
    assert header[-2:] == ["Condition", "binary_condition"] and "PatientID" not in header
    assert load_bundle(parts["bundle"], spark).preprocessing == study.bundle.preprocessing


def test_low_values_are_low_and_missing_ones_are_not(spark, binary_study, samples):
    prep = binary_study.bundle.preprocessing
    name = prep.features[0]
    held = spark.createDataFrame([(0, "-5"), (1, "n/a"), (2, "0"), (3, "1e9")], "row_id long, v string").withColumnRenamed("v", name)
    one = clean.clean_numeric(held, [name])
    from dataclasses import replace

    own = replace(prep, features=[name], offsets={name: prep.offsets[name]}, medians={name: prep.medians[name]}, lowest={name: prep.lowest[name]},
                  scaling=replace(prep.scaling, means={name: prep.scaling.means[name]}, stds={name: prep.scaling.stds[name]}))
    scaled = {r["row_id"]: (r[name], r["n_clamped"]) for r in own.transform_filled(own.count_clamped(one)).collect()}
    assert scaled[0] == scaled[2] and scaled[0][0] < scaled[1][0] < scaled[3][0]
    assert [scaled[i][1] for i in range(4)] == [1, 0, 1, 0]


def test_bundles_refuse_the_wrong_score(samples, binary_study):
    from dataclasses import replace

    with pytest.raises(ValueError, match="rank types"):
        scoring.score_types(samples, binary_study.bundle)
    with pytest.raises(ValueError, match="score a risk"):
        scoring.score_risk(samples, replace(binary_study.bundle, kind="type", classes=["a", "b", "c"]))


def test_several_input_paths(spark, samples, tmp_path):
    samples.limit(30).write.parquet(str(tmp_path / "a"))
    samples.limit(20).write.parquet(str(tmp_path / "b"))
    assert read_samples(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 50


def test_all_rows_can_be_explained(samples):
    study = run_latent(samples.limit(60), "binary", k=2, iterations=2, background_rows=2, explained_rows=None)
    assert study.tables["attributions"].select("row_id").distinct().count() == 60
    study.release()
