"""Hand-checked cases for the number, fold, metric and loss rules."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import vectors
from cohortlens.operators import clean, curves, evaluate, explain, folds, latent, profile, scale
from cohortlens.operators.lookup import lookup_join


def near(values, expected, tol=1e-6):
    assert len(values) == len(expected)
    for a, b in zip(values, expected):
        assert a == b or (a is not None and b is not None and abs(a - b) < tol), (values, expected)


def column(df, name, order="row_id"):
    return [r[name] for r in df.orderBy(order).collect()]


def frame(spark, values, schema="x double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id int, {schema}")


@pytest.mark.parametrize(
    "text, number",
    [
        ("12.5*", 12.5), ("**7", 7.0), (" 5 ", 5.0), ("1e3", 1000.0), ("+3", 3.0), (".5", 0.5), ("5.", 5.0),
        ("inf", math.inf), ("-Infinity", -math.inf), ("n/a", None), ("1,000", None), ("", None), (None, None),
        ("1.5d", None), ("1.5f", None), ("1e400", None), ("NaN", None), ("0x10", None), ("1_000", None), ("*", None),
    ],
)
def test_text_to_number(spark, text, number):
    assert clean.clean_numeric(frame(spark, [text], "x string")).first()["x"] == number


def test_clean_leaves_ids_and_numbers(spark):
    df = spark.createDataFrame([("1*", "P1*", 2, float("nan"))], "`CA 15-3 (U/ml)` string, PatientID string, n int, v double")
    row = clean.clean_numeric(df).first()
    assert tuple(row) == (1.0, "P1*", 2, None)


@pytest.mark.parametrize(
    "values, expected",
    [([-3.0, 0.0, 5.0], [0, 2, math.log2(9)]), ([0.0, 1.0, 3.0], [0, 1, 2]), ([1.0, 2.0, 8.0], [0, 1, 3]), ([1.0, None, 4.0], [0, None, 2])],
)
def test_log2(spark, values, expected):
    near(column(scale.log2_normalize(frame(spark, values), ["x"]), "x"), expected)


def test_log2_excludes_columns(spark):
    df = spark.createDataFrame([(2.0, 60.0)], "x double, Age double")
    assert tuple(scale.log2_normalize(df, ["x", "Age"], exclude=["Age"]).first()) == (1.0, 60.0)


@pytest.mark.parametrize("values, expected", [([1.0, 2.0, 3.0], [-1.224745, 0, 1.224745]), ([4.0, 4.0, 4.0], [0, 0, 0])])
def test_standardize(spark, values, expected):
    near(column(scale.standardize(frame(spark, values), ["x"]), "x"), expected)


def test_standardize_refuses_infinity(spark):
    with pytest.raises(ValueError):
        scale.fit_standardize(frame(spark, [1.0, math.inf]), ["x"])


@pytest.mark.parametrize(
    "values, expected", [([1.0, None, 2.0, 10.0], 2.0), ([1.0, 2.0, 3.0, 10.0, float("nan")], 2.5), ([None], None), ([7.0], 7.0)]
)
@pytest.mark.parametrize("in_memory", [20_000, 0])
def test_median(spark, values, expected, in_memory):
    assert scale.fit_medians(frame(spark, values), ["x"], in_memory) == {"x": expected}


def test_median_narrowing_matches_sort(spark):
    df = spark.range(5000).selectExpr(
        "id", "cast(pmod(hash(id), 100000) as double) as a", "cast(pmod(hash(id), 3) as double) as b", "if(id % 2 = 0, 1.0D, 9.0D) as c"
    )
    rows = df.toPandas()
    medians = scale.fit_medians(df, ["a", "b", "c"], in_memory=5)
    assert medians == {c: rows[c].median() for c in "abc"}
    assert medians["c"] == 5.0


def test_fill_median(spark):
    assert column(scale.fill_median(frame(spark, [1.0, None, 2.0, 10.0]), ["x"]), "x") == [1.0, 2.0, 2.0, 10.0]


def test_median_of_cells(spark):
    df = spark.createDataFrame([(1.0, 10.0), (None, 2.0)], "a double, b double")
    assert scale.median_of_cells(df, ["a", "b"]) == 2.0


def test_binary_label_null_is_cancer(spark):
    df = frame(spark, ["Normal", "Lung", None], "Condition string")
    assert column(clean.binary_label(df), "binary_condition") == [0, 1, 1]
    assert clean.exclude_class(df).count() == 2


def test_label_codes_are_sorted(spark):
    df = frame(spark, ["Ovary", "Breast", "Lung"], "Condition string")
    codes = clean.fit_label_codes(df, "Condition")
    coded = clean.encode_labels(df, codes)
    assert column(coded, "label") == [2, 0, 1]
    assert column(clean.decode_labels(coded, "label", codes.labels, "back"), "back") == ["Ovary", "Breast", "Lung"]


def test_feature_columns_order():
    columns = ["Omega score", "AXL (pg/ml)", "Age", "AFP (pg/ml)", "other"]
    assert clean.feature_columns(columns) == ["AFP (pg/ml)", "AXL (pg/ml)", "Omega score"]
    assert clean.feature_columns(columns, use_age=True)[-1] == "Age"


def test_balanced_and_positive_weights(spark):
    df = frame(spark, ["a"] * 6 + ["b"] * 3 + ["c"], "label string")
    near(column(folds.balanced_weights(df), "weight", "label"), [0.555556, 1.111111, 3.333333])
    weighted = folds.attach_weights(df, folds.balanced_weights(df))
    assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(10.0)
    binary = frame(spark, [0] * 30 + [1] * 10, "label int")
    assert folds.positive_weight(binary).first()["pos_weight"] == 3.0


def test_lookup_join_with_salts(spark):
    df = frame(spark, ["a"] * 60 + ["b", None], "label string")
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "label string, w double")
    small = lookup_join(df, table, ["label"])
    large = lookup_join(df, table, ["label"], salts=4)
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)
    assert small.count() == 62


@pytest.mark.parametrize("k", [3, 10])
def test_folds_are_balanced(spark, k):
    df = spark.range(977).selectExpr("id as row_id", "if(id % 11 = 0, null, if(id % 3 = 0, 'hot', concat('c', id % 5))) as label")
    split = folds.stratified_folds(df, "label", "row_id", k=k, hash_digits=1)
    assert split.count() == 977 and split.select("row_id").distinct().count() == 977
    overall = [r["count"] for r in split.groupBy("fold").count().collect()]
    assert len(overall) == k and max(overall) - min(overall) <= 1
    for spread in split.groupBy("label", "fold").count().groupBy("label").agg(F.max("count") - F.min("count")).collect():
        assert spread[1] <= 1


def test_folds_do_not_depend_on_partitioning(spark):
    df = spark.range(200).selectExpr("id as row_id", "cast(id % 3 as int) as label")
    a = folds.stratified_folds(df, "label", "row_id", k=5, hash_digits=4)
    b = folds.stratified_folds(df.repartition(7), "label", "row_id", k=5, hash_digits=1)
    assert sorted(a.collect()) == sorted(b.collect())


def test_percent_denominators(spark):
    df = frame(spark, ["A", "A", "B", None], "c string")
    near(column(profile.value_percentages(df, "c"), "pct", "c"), [66.666667, 33.333333])
    near(column(profile.value_percentages(df, "c", "rows"), "pct", "c"), [50, 25])


def test_crosstab_pct(spark):
    df = spark.createDataFrame([("Lung", "I"), ("Lung", "I"), ("Lung", "II"), ("Liver", "II"), ("Liver", None)], "t string, s string")
    rows = {r["s"]: r for r in profile.crosstab_pct(df, "s", "t").collect()}
    near([rows["I"]["Lung"], rows["II"]["Lung"], rows["I"]["Liver"], rows["II"]["Liver"]], [66.666667, 33.333333, 0, 100])


def test_demographic_and_stage_columns(spark):
    df = spark.createDataFrame([("I", 1, "x"), ("II", 2, "x")], "Stage string, AGE int, sex string")
    found = {r["column_name"]: r["n_distinct"] for r in profile.demographic_columns(df).collect()}
    assert found == {"Stage": 2, "AGE": 2}
    assert profile.stage_column(df) == "Stage"
    assert profile.stage_column(spark.range(9).withColumnRenamed("id", "stage_code")) is None
    assert profile.demographic_columns(spark.range(3)).count() == 0


def test_missing_reports(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "a"), (2.0, "b")], "x double, s string")
    assert {r[0]: r[1] for r in profile.missing_report(df, ["x", "s"]).collect()} == {"x": 1, "s": 1}
    row = profile.removal_report(df, ["x", "s"]).first()
    assert (row["n_removed"], row["n_kept"], row["n_missing_cells"]) == (2, 1, 2)
    assert clean.drop_missing(df, ["x"]).count() == 2


GOLDEN_SCORES = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]


@pytest.mark.parametrize("ranges", [None, 2, 64])
def test_roc_golden(spark, ranges):
    df = spark.createDataFrame(GOLDEN_SCORES, "label int, score double")
    points = [tuple(r) for r in curves.roc_curve(df, ranges=ranges).orderBy(F.desc("threshold")).collect()]
    assert points == [(math.inf, 0, 0), (0.9, 0, 0.5), (0.8, 0.5, 0.5), (0.7, 0.5, 1), (0.1, 1, 1)]
    assert curves.auc(df, ranges=ranges).first()["auc"] == 0.75
    op = curves.threshold_at_specificity(curves.roc_curve(df)).first()
    assert tuple(op) == (0.9, 0.5, 1.0)


def test_threshold_when_nothing_is_callable(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.8), (0, 0.1)], "label int, score double")
    op = curves.threshold_at_specificity(curves.roc_curve(df))
    assert tuple(op.first())[:2] == (math.inf, 0.0)
    assert curves.apply_threshold(df, op).agg(F.sum("called")).first()[0] == 0


def test_nearest_threshold_takes_the_higher_on_ties(spark):
    scores = [(1, 0.75), (0, 0.5), (1, 0.25)]
    points = curves.roc_curve(spark.createDataFrame(scores, "label int, score double"))
    assert curves.nearest_threshold(points, 0.625).first()["threshold"] == 0.75
    assert curves.nearest_threshold(points, 0.3).first()["threshold"] == 0.25
    assert curves.nearest_threshold(points, math.inf).first()["threshold"] == math.inf


def brute_roc(pairs):
    """Published algorithm, on lists: all points, then those on a straight line dropped."""
    thresholds = sorted({s for _, s in pairs}, reverse=True)
    counts = [(sum(y for y, s in pairs if s >= t), sum(1 - y for y, s in pairs if s >= t)) for t in thresholds]
    keep = [
        i for i in range(len(counts))
        if i in (0, len(counts) - 1) or any(counts[i + 1][j] - 2 * counts[i][j] + counts[i - 1][j] for j in (0, 1))
    ]
    p, q = counts[-1]
    return [(math.inf, 0.0, 0.0)] + [(thresholds[i], counts[i][1] / q, counts[i][0] / p) for i in keep]


@pytest.mark.parametrize("levels, ranges", [(7, 3), (40, 5), (1000, 16), (2, 4)])
def test_roc_matches_brute_force(spark, levels, ranges):
    df = spark.range(400).selectExpr(
        "cast(pmod(hash(id, 1), 3) = 0 as int) as label", f"cast(pmod(hash(id, 2), {levels}) as double) / {levels} as score"
    )
    pairs = [(r["label"], r["score"]) for r in df.collect()]
    points = [tuple(r) for r in curves.roc_curve(df, ranges=ranges).orderBy(F.desc("threshold")).collect()]
    assert points == brute_roc(pairs)
    positives = [s for y, s in pairs if y]
    negatives = [s for y, s in pairs if not y]
    ranked = sum((a > b) + 0.5 * (a == b) for a in positives for b in negatives)
    assert curves.auc(df, ranges=ranges).first()["auc"] == pytest.approx(ranked / len(positives) / len(negatives))
    assert curves.auc_of_points(curves.roc_curve(df)).first()["auc"] == pytest.approx(ranked / len(positives) / len(negatives))


def test_auc_by_fold_skips_single_class_folds(spark):
    rows = [(0, y, s) for y, s in GOLDEN_SCORES] + [(1, 1, 0.5), (1, 1, 0.6)]
    df = spark.createDataFrame(rows, "fold int, label int, score double")
    assert [tuple(r)[:2] for r in curves.auc(df, by=["fold"]).collect()] == [(0, 0.75)]


def test_sensitivity_errors(spark):
    rows = [("I", i < 1) for i in range(4)] + [("III", i < 3) for i in range(4)]
    df = spark.createDataFrame([(s, int(c), 1) for s, c in rows] + [("I", 1, 0), (None, 1, 1)], "Stage string, called int, label int")
    got = {r["Stage"]: (r["sensitivity"], r["error"], r["total"]) for r in evaluate.sensitivity_by(df, "Stage").collect()}
    near([*got["I"], *got["III"]], [0.25, 0.216506, 4, 0.75, 0.216506, 4])
    wide = evaluate.sensitivity_by(df, "Stage", z=evaluate.NINETY_FIVE_PERCENT).filter("Stage = 'I'").first()
    near([wide["error"]], [0.424352])


def test_top_k_ties_take_the_lower_index(spark):
    df = frame(spark, [[0.2, 0.5, 0.3], [0.4, 0.4, 0.2]], "p array<double>")
    assert column(df.withColumn("t", vectors.top_k(F.col("p"), 2)), "t") == [[1, 2], [0, 1]]
    assert column(df.withColumn("a", vectors.argmax(F.col("p"))), "a") == [1, 0]
    assert column(df.withColumn("h", vectors.in_top_k(F.lit(2), F.col("p"), 2)), "h") == [True, False]


def test_one_vs_rest_probabilities_sum_to_one(spark):
    p = frame(spark, [[0.3, -2.0, 5.0]], "r array<double>").select(vectors.one_vs_rest_probabilities(F.col("r"))).first()[0]
    assert sum(p) == pytest.approx(1.0) and p[2] > p[0] > p[1]


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, prediction string")
    report = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert tuple(report["b"])[1:] == (0.0, 0.0, 0.0, 1)
    near([report["a"]["precision"], report["a"]["f1"], report["accuracy"]["f1"], report["macro avg"]["recall"]], [0.5, 2 / 3, 0.5, 0.5])


def test_confusion_matrix_has_all_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 2)], "label int, prediction int")
    rows = [tuple(r) for r in evaluate.confusion_matrix(df, [0, 1, 2]).orderBy("label").collect()]
    assert rows == [(0, 1, 0, 1), (1, 0, 0, 0), (2, 0, 0, 0)]


def test_topk_by_class_and_bars(spark):
    df = spark.createDataFrame([(0, 0, [0.6, 0.3, 0.1]), (0, 1, [0.3, 0.6, 0.1]), (1, 2, [0.3, 0.1, 0.6])], "label int, prediction int, probs array<double>")
    by_class = evaluate.topk_accuracy_by_class(df, ["Lung", "ovary", "Other"])
    got = {r["class"]: (r["total"], r["top1"], r["top2"]) for r in by_class.collect()}
    assert got == {"Lung": (2, 0.5, 1.0), "ovary": (1, 0.0, 0.0), "Other": (0, 0.0, 0.0)}
    assert [r["class"] for r in evaluate.topk_stack(by_class).collect()] == ["ovary", "Lung", "Other"]


def test_predictions_join_by_key(spark):
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(1, 5)], "row_id int, s string")
    oof = spark.createDataFrame([(i, i * 10) for i in range(5)], "row_id int, prediction int")
    joined = evaluate.attach_predictions(samples, oof)
    assert column(joined, "prediction") == [10, 20, 30, 40]


def test_best_fold_takes_the_first(spark):
    df = spark.createDataFrame([(2, 0.9), (1, 0.9), (0, 0.5)], "fold int, accuracy double")
    assert evaluate.best_fold(df).first()["fold"] == 1
    assert evaluate.mean_std(df, "accuracy").first()["std"] == pytest.approx(0.188562, abs=1e-6)


def test_loss_parts(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [1.0, 0.0], [1.0], [0.0], [0.0, 0.0], 0)],
        "x array<double>, x_recon array<double>, mu array<double>, log_var array<double>, logits array<double>, label int",
    )
    row = latent.joint_loss(df).first()
    near([row["recon"], row["kl"], row["cls"], row["loss"], row["avg_loss"]], [4, 0.5, 0.693147, 20.362944, 20.362944])


def test_joint_loss_skips_nan_samples(spark):
    good, bad = [1.0], [float("nan")]
    df = spark.createDataFrame(
        [(good, [0.0], [0.0], [0.0], [0.0, 0.0], 0), (bad, [0.0], [0.0], [0.0], [0.0, 0.0], 0)],
        "x array<double>, x_recon array<double>, mu array<double>, log_var array<double>, logits array<double>, label int",
    )
    row = latent.joint_loss(df).first()
    assert row["n"] == 2 and row["recon"] == 1.0 and row["avg_recon"] == 0.5


def test_nan_to_zero(spark):
    df = frame(spark, [[1.0, float("nan"), None]], "z array<double>")
    assert df.select(vectors.nan_to_zero(F.col("z"))).first()[0] == [1.0, 0.0, 0.0]


def linear(df):
    return df.withColumn("scores", F.array(2.0 * F.col("x")[0] - F.col("x")[1]))


def test_shapley_of_a_linear_score(spark):
    background = spark.createDataFrame([(1, 0.0, 2.0), (2, 2.0, 0.0)], "row_id int, a double, b double")
    rows = spark.createDataFrame([(9, 3.0, 0.0)], "row_id int, a double, b double")
    phi = {r["feature"]: r for r in explain.shapley_attributions(rows, ["a", "b"], linear, background).collect()}
    assert phi["a"]["phi"] == pytest.approx(4.0) and phi["b"]["phi"] == pytest.approx(1.0)
    assert phi["a"]["base"] == pytest.approx(1.0) and phi["a"]["value"] == 3.0


def test_shapley_adds_up_for_any_score(spark):
    def score(df):
        x = F.col("x")
        return df.withColumn("scores", F.array(x[0] * x[1] + x[2], F.exp(x[0]) * x[2]))

    data = spark.range(12).selectExpr("id as row_id", "id * 0.1 as a", "sin(id) as b", "cos(id) as c")
    background, rows = data.filter("row_id < 5"), data.filter("row_id >= 9")
    phi = explain.shapley_attributions(rows, ["a", "b", "c"], score, background, rounds=2)
    summed = phi.groupBy("row_id", "class").agg((F.sum("phi") + F.first("base")).alias("total"))
    direct = score(rows.withColumn("x", F.array("a", "b", "c"))).select("row_id", F.posexplode("scores").alias("class", "f"))
    for r in summed.join(direct, ["row_id", "class"]).collect():
        assert r["total"] == pytest.approx(r["f"])
    assert phi.count() == 3 * 2 * 3


def test_waterfall_sums_the_rest(spark):
    rows = [(1, f"f{i}", float(i), (-1.0) ** i * i, 0.25) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "row_id int, feature string, value double, phi double, base double")
    shown = explain.waterfall_rows(df, 1).collect()
    assert [r["feature"] for r in shown] == [f"f{i}" for i in range(12, 3, -1)] + ["other"]
    assert shown[-1]["phi"] == pytest.approx(-3 + 2 - 1) and shown[-1]["value"] is None
