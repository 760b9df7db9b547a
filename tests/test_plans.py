"""Shapes of physical plans: what is read, what is shuffled, what never appears."""

from __future__ import annotations

import re

import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from cohortlens.bindings.registry import table
from cohortlens.bindings.views import assay_cohort
from cohortlens.operators import clean, curves, evaluate, explain, folds, profile, ranking, scale
from cohortlens.plans.common import prepare_cohort


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def orders(spark):
    return table(spark, MEDIUM, "orders")


def test_scans_read_only_the_columns_used(spark):
    text = plan(profile.value_counts(orders(spark), "o_orderpriority"))
    assert "ReadSchema: struct<o_orderpriority:string>" in text and "IsNotNull(o_orderpriority)" in text
    text = plan(clean.exclude_class(orders(spark), "o_orderstatus", "P").select("o_orderkey"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text and "PushedFilters: [Not(EqualNullSafe(o_orderstatus,P))]" in text


def test_rows_are_shuffled_once_for_folds(spark):
    """The wide side of the rank join keeps the window's partitioning."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(folds.stratified_folds(orders(spark), "o_orderstatus", "o_orderkey"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [line for line in text.splitlines() if "FileScan" in line and "o_orderdate" in line]
    assert len(wide) == 1
    above = text[: text.index(wide[0])]
    assert above.rsplit("SortMergeJoin", 1)[-1].count("Exchange") >= 1
    branch = text[text.index("Window [row_number()"): text.index(wide[0])]
    assert branch.count("Exchange") == 1 and "SinglePartition" not in branch


def test_curve_never_sorts_all_scores_in_one_task(spark):
    scores = orders(spark).select(F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    text = plan(curves.score_ladder(scores))
    single = text[text.index("SinglePartition"):] if "SinglePartition" in text else ""
    # What reaches the single partition is one row per score range, already aggregated.
    assert re.match(r"SinglePartition.*\n.*HashAggregate|SinglePartition.*\n.*SortAggregate", single)
    assert "Window" in text and "CartesianProduct" not in text


def test_no_operator_needs_python_workers_or_cross_joins(spark):
    lines = table(spark, MEDIUM, "lineitem")
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    split = folds.stratified_folds(clean.binary_label(orders(spark), "o_orderstatus", "O", "label"), "label", "o_orderkey")
    frames = [
        scale.standardize(scale.log2_normalize(lines, features), features),
        clean.clean_numeric(lines),
        folds.fold_class_distribution(split, "label"),
        evaluate.classification_report(split.withColumn("prediction", F.col("label"))),
        profile.crosstab_pct(lines, "l_returnflag", "l_linestatus", ["O", "F"]),
        ranking.top_n_per_group(lines, "l_returnflag", value="l_tax", name="l_orderkey"),
    ]
    for df in frames:
        text = plan(df)
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|MapInPandas|ArrowEval", text)


def test_group_limit_runs_before_the_shuffle(spark):
    text = plan(ranking.top_n_per_group(table(spark, MEDIUM, "lineitem"), "l_returnflag", value="l_tax", name="l_orderkey"))
    assert text.count("WindowGroupLimit") == 2


def test_sample_keeps_n_rows_per_task(spark):
    assert "TakeOrderedAndProject" in plan(folds.sample_n(orders(spark), 50, "o_orderkey"))


def jobs_of(spark, group: str, build):
    """What ``build`` returns, and how many jobs it started."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return build(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_curve_shuffles_its_scores_once(spark):
    scores = orders(spark).select(
        F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), "o_orderpriority"
    )
    for by in ([], ["o_orderpriority"]):
        points = curves.roc_curve(scores, by=by)
        points.collect()
        final = plan(points).split("Initial Plan")[0]
        assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


def test_lookups_start_no_job(spark):
    oof = orders(spark).selectExpr("o_totalprice as score", "cast(o_orderkey % 3 as int) as fold", "1 as prediction")
    points = spark.createDataFrame([(0, 1000.0, 0.5, 0.99), (1, 0.5, None, None), (2, float("inf"), 0.0, 1.0)], "fold int, threshold double, sensitivity double, specificity double")
    hits, started = jobs_of(spark, "apply-threshold", lambda: curves.apply_threshold(oof, points, ["fold"]))
    assert started == 0
    called = {tuple(r) for r in hits.filter("score > 1000").select("fold", "called").distinct().collect()}
    assert called == {(0, 1), (1, 1), (2, 0)}
    weighted, started = jobs_of(spark, "weights", lambda: folds.attach_weights(oof, folds.balanced_weights(oof, "fold"), "fold"))
    assert started == 0 and weighted.count() == oof.count()


def test_background_has_no_largest_size(spark):
    rows = spark.range(2).selectExpr("id as row_id", "double(id) as a", "double(id * 2) as b")
    background = spark.range(25_000).selectExpr("id as row_id", "double(id % 5) as a", "double(id % 3) as b")

    def score(df):
        return df.withColumn("scores", F.array(F.get("x", F.lit(0)) + 10 * F.get("x", F.lit(1))))

    phi = {(r["row_id"], r["feature"]): r["phi"] for r in explain.shapley_attributions(rows, ["a", "b"], score, background).collect()}
    mean_b = sum(i % 3 for i in range(25_000)) / 25_000
    assert phi[1, "a"] == pytest.approx(1 - 2.0) and phi[1, "b"] == pytest.approx(10 * (2 - mean_b))


def test_preparing_a_cohort_takes_few_passes(spark, monkeypatch):
    """One aggregation for counts, classes and smallest values, one for the scaling; medians only on request."""

    def unwanted(*_, **__):
        raise AssertionError("a pass of its own")

    monkeypatch.setattr(scale, "fit_lowest", unwanted)
    monkeypatch.setattr(clean, "fit_label_codes", unwanted)
    samples = assay_cohort(spark, SMALL)
    with monkeypatch.context() as without:
        without.setattr(scale, "fit_medians", unwanted)
        cohort, started = jobs_of(spark, "prepare", lambda: prepare_cohort(samples, "type", 3, with_medians=False))
    assert cohort.preprocessing.medians == {} and cohort.classes == ["Breast", "Lung", "Normal", "Ovary"]
    _, with_medians = jobs_of(spark, "prepare-all", lambda: prepare_cohort(samples, "type", 3))
    assert started < with_medians


def test_bound_fits_follow_the_rows(spark, monkeypatch):
    from cohortlens.bindings import models as bound

    monkeypatch.setattr(bound.models, "fit_boosted_binary", lambda rows, *_: rows.rdd.getNumPartitions())
    for n, tasks in ((40_000, 8), (400_000, 12), (100, 2)):
        table = spark.range(0, n, 1, 12).selectExpr("id row_id", "int(id % 2) label")
        monkeypatch.setattr(bound, "binary_rows", lambda *_, table=table: table)
        assert bound.binary_model(spark, f"rows-{n}") == tasks
