"""Sources and sinks: written, read back and compared; and the flagship report."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.bindings.curves import operating_point_sql, roc_sql, sensitivity_sql
from cohortlens.bindings.evaluation import TYPE
from cohortlens.bindings.latent import GIVEN_SQL, given_attributions
from cohortlens.bindings.registry import query, rounded, table
from cohortlens.bindings.views import CLASS_LABELS, STAGED_OOF_SQL, staged_oof, type_oof
from cohortlens.operators import clean, curves, evaluate, explain, folds, report, scale
from cohortlens.sources import sinks
from cohortlens.sources.samples import read_samples
from cohortlens.sources.schema import find_label_column, sample_schema
from cohortlens.sources.staging import scratch_path, stage


def _raw_customers(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.col("c_mktsegment").alias("Condition"),
        F.concat(F.lit("*"), F.col("c_acctbal").cast("string")).alias("AFP (pg/ml)"),
    )


@query(
    "read_samples_csv",
    """select c_custkey as row_id, c_mktsegment as "Condition", c_acctbal as "AFP (pg/ml)" from customer""",
)
def read_samples_csv(spark, sf):
    raw = _raw_customers(spark, sf)
    path = scratch_path(spark, "samples")
    raw.write.option("header", True).csv(path)
    samples = read_samples(spark, path, sample_schema(raw.columns), fmt="csv")
    return clean.clean_numeric(samples, ["AFP (pg/ml)"])


@query(
    "read_samples_fallback",
    """select c_custkey as row_id, c_mktsegment as "Condition", '*' || cast(c_acctbal as varchar) as "AFP (pg/ml)"
       from customer where c_mktsegment is distinct from 'BUILDING'""",
)
def read_samples_fallback(spark, sf):
    path = scratch_path(spark, "all-samples")
    _raw_customers(spark, sf).write.parquet(path)
    return read_samples(spark, path + "-positives", fallback=path, exclude="BUILDING")


@query("find_label_column", "select c_mktsegment as label, count(*) as n from customer group by 1")
def find_label(spark, sf):
    named = table(spark, sf, "customer").withColumnsRenamed({"c_mktsegment": "Main Diagnosis"})
    label = find_label_column(named.columns)
    return named.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "write_preprocessed",
    """select round((c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over (), 6) as "AFP (pg/ml)",
              c_mktsegment as "Condition", (case when c_mktsegment = 'BUILDING' then 0 else 1 end)::int as binary_condition
       from customer""",
)
def write_preprocessed(spark, sf):
    cleaned = clean.binary_label(clean.clean_numeric(_raw_customers(spark, sf), ["AFP (pg/ml)"]), normal="BUILDING")
    path = scratch_path(spark, "preprocessed")
    sinks.write_preprocessed(scale.standardize(cleaned, ["AFP (pg/ml)"]), path, ["AFP (pg/ml)"])
    schema = "`AFP (pg/ml)` double, Condition string, binary_condition int"
    return rounded(spark.read.schema(schema).option("header", True).csv(path), ["AFP (pg/ml)"])


# A row per feature: the mean size of the 64 numbers of the vectors as contributions.
IMPORTANCE_SQL = f"{GIVEN_SQL}, i as (select feature, avg(abs(phi)) as a from given group by 1)"


def _importance(spark, sf):
    return explain.shap_ranking(given_attributions(spark, sf))


@query("write_importance", f"""with {IMPORTANCE_SQL} select feature as "Feature", round(a, 6) as "Importance" from i""")
def write_importance(spark, sf):
    path = scratch_path(spark, "importance")
    sinks.write_importance(_importance(spark, sf), path)
    return rounded(spark.read.schema("Feature string, Importance double").option("header", True).csv(path), ["Importance"])


@query(
    "write_top_features",
    f"""with {IMPORTANCE_SQL}, r as (select row_number() over (order by a desc, feature) as n, * from i)
       select n::int as "Rank", feature as "Feature", round(round(a, 6), 4) as "SHAP Importance" from r where n <= 20""",
)
def write_top_features(spark, sf):
    path = scratch_path(spark, "top-features")
    sinks.write_top_features(_importance(spark, sf), path)
    schema = "Rank int, Feature string, `SHAP Importance` double"
    back = spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)
    return back.withColumn("SHAP Importance", F.round("SHAP Importance", 4))


@query(
    "write_confusion",
    f"{TYPE} select 'class ' || label as class, "
    + ", ".join(f'count(*) filter (where prediction = {c}) as "class {c}"' for c in range(10))
    + " from oof group by 1",
)
def write_confusion(spark, sf):
    path = scratch_path(spark, "confusion")
    sinks.write_confusion(evaluate.confusion_matrix(type_oof(spark, sf), list(range(10))), path, CLASS_LABELS)
    schema = "class string, " + ", ".join(f"`{c}` bigint" for c in CLASS_LABELS)
    return spark.read.schema(schema).option("header", True).csv(path)


@query(
    "metrics_table",
    f"""with {STAGED_OOF_SQL},
        s as (select "Stage", count(*) filter (where prediction = 1)::double / count(*) as p, count(*) as n
              from oof where label = 1 group by 1)
        select 'dataset' as section, 'final rows' as key, count(*)::double as value from oof
        union all select 'confusion', 'all true_negative', count(*)::double from oof where label = 0 and prediction = 0
        union all select 'confusion', 'all false_positive', count(*)::double from oof where label = 0 and prediction = 1
        union all select 'confusion', 'all false_negative', count(*)::double from oof where label = 1 and prediction = 0
        union all select 'confusion', 'all true_positive', count(*)::double from oof where label = 1 and prediction = 1
        union all select 'sensitivity by stage', "Stage" || ' sensitivity', round(p, 6) from s
        union all select 'sensitivity by stage', "Stage" || ' error', round(sqrt(p * (1 - p) / n), 6) from s""",
)
def metrics_table(spark, sf):
    oof = staged_oof(spark, sf)
    cells = ("true_negative", "false_positive", "false_negative", "true_positive")
    parts = [
        report.facts(spark, "dataset", {"final rows": oof.count()}),
        report.section(evaluate.confusion_cells(oof), "confusion", F.lit("all"), *cells),
        report.section(
            evaluate.sensitivity_by(oof, "Stage", called="prediction"), "sensitivity by stage", "Stage", "sensitivity", "error"
        ),
    ]
    return rounded(report.metrics_table(*parts), ["value"])


# --- flagship ---------------------------------------------------------------

SCORE_REPORT_SQL = f"""
with logged as (
  select c_custkey as row_id, c_mktsegment as "Condition", log2(c_acctbal + abs(min(c_acctbal) over ()) + 1) as v,
         case when c_mktsegment = 'BUILDING' then 0 else 1 end as label from customer),
scaled as (
  select row_id, "Condition", label, round((v - avg(v) over ()) / stddev_pop(v) over (), 6) as score from logged),
oof as (
  select *, (row_number() over (order by label, md5(concat('42|', cast(row_id as varchar))), row_id) - 1) % 10 as fold from scaled),
{roc_sql('oof', 'fold')}, {operating_point_sql('fold')},
called as (select oof.*, (score >= threshold)::int as hit from oof join op using (fold)),
{sensitivity_sql('"Condition"', 'hit', '1.96')}
"""


@query("binary_score_report", SCORE_REPORT_SQL)
def binary_score_report(spark, sf):
    """Log2, scale, fold, score by the scaled value, per-fold operating point, sensitivity."""
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("Condition"), F.col("c_acctbal").alias("score")
    )
    labelled = clean.binary_label(customers, normal="BUILDING", out="label")
    scaled = rounded(scale.standardize(scale.log2_normalize(labelled, ["score"]), ["score"]), ["score"])
    oof = stage(folds.stratified_folds(scaled, "label", "row_id"), "score-report")
    per_fold = curves.threshold_at_specificity(curves.roc_curve(oof, by=["fold"]), ["fold"])
    hits = curves.apply_threshold(oof, per_fold, ["fold"])
    by_class = evaluate.sensitivity_by(hits, "Condition", z=evaluate.NINETY_FIVE_PERCENT)
    return rounded(by_class, ["sensitivity", "error"])
