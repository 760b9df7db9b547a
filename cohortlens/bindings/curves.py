"""ROC curves and operating points."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.bindings.registry import query, rounded, table
from cohortlens.bindings.views import BINARY_OOF_SQL, STAGED_OOF_SQL, binary_cohort, staged_binary_oof, staged_oof
from cohortlens.operators import curves, evaluate


def roc_sql(source: str, by: str | None = None) -> str:
    """CTEs ending in ``pts(by, thr, fpr, tpr)`` over a table with ``score`` and ``label``."""
    key = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    origin = (
        f"select {by}, 'inf'::double, 0.0::double, 0.0::double from c group by {by}"
        if by
        else "select 'inf'::double, 0.0::double, 0.0::double"
    )
    return f"""
    g as (select {key}score, sum(label) as tp, sum(1 - label) as fp from {source} group by {key}score),
    c as (select {key}score as thr,
                 sum(tp) over ({part}order by score desc rows unbounded preceding) as tps,
                 sum(fp) over ({part}order by score desc rows unbounded preceding) as fps from g),
    d as (select {key}thr, tps, fps,
                 lag(tps) over ({part}order by thr desc) as pt, lead(tps) over ({part}order by thr desc) as nt,
                 lag(fps) over ({part}order by thr desc) as pf, lead(fps) over ({part}order by thr desc) as nf,
                 max(tps) over ({part}) as p, max(fps) over ({part}) as q from c),
    pts as (select {key}thr, fps::double / nullif(q, 0) as fpr, tps::double / nullif(p, 0) as tpr from d
            where pt is null or nt is null or nt - 2 * tps + pt <> 0 or nf - 2 * fps + pf <> 0
            union all {origin})
    """


def auc_sql(points: str, by: str | None = None) -> str:
    key = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    group = f"group by {by}" if by else ""
    return f"""
    steps as (select {key}(fpr - lag(fpr) over ({part}order by thr desc)) * (tpr + lag(tpr) over ({part}order by thr desc)) / 2 as slab
              from {points}),
    areas as (select {key}sum(slab) as auc from steps {group})
    """


BINARY_CURVE = f"with {BINARY_OOF_SQL}, {roc_sql('oof')}"
FOLD_CURVE = f"with {BINARY_OOF_SQL}, {roc_sql('oof', 'fold')}"
ROUNDED_POINTS = "round(fpr, 6) as fpr, round(tpr, 6) as tpr"


@query("roc_curve", f"{BINARY_CURVE} select thr as threshold, {ROUNDED_POINTS} from pts")
def roc_curve(spark, sf):
    return rounded(curves.roc_curve(binary_cohort(spark, sf)), ["fpr", "tpr"])


@query("roc_curve_by_fold", f"{FOLD_CURVE} select fold::int as fold, thr as threshold, {ROUNDED_POINTS} from pts")
def roc_curve_by_fold(spark, sf):
    return rounded(curves.roc_curve(staged_binary_oof(spark, sf), by=["fold"]), ["fpr", "tpr"])


LINE_CURVE = f"""
with oof as (select l_discount as score, case when l_returnflag = 'R' then 1 else 0 end as label, l_linestatus from lineitem),
{roc_sql('oof')}"""


def _line_scores(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_linestatus"
    )


@query("roc_curve_tied_scores", f"{LINE_CURVE} select thr as threshold, {ROUNDED_POINTS} from pts")
def roc_curve_tied_scores(spark, sf):
    return rounded(curves.roc_curve(_line_scores(spark, sf)), ["fpr", "tpr"])


LINE_PRICE_CURVE = f"""
with oof as (select l_extendedprice as score, case when l_returnflag = 'R' then 1 else 0 end as label, l_linestatus from lineitem),
{roc_sql('oof', 'l_linestatus')}"""


@query("roc_curve_by_status", f"{LINE_PRICE_CURVE} select l_linestatus, thr as threshold, {ROUNDED_POINTS} from pts")
def roc_curve_by_status(spark, sf):
    scores = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_linestatus"
    )
    return rounded(curves.roc_curve(scores, by=["l_linestatus"]), ["fpr", "tpr"])


DOC_CURVE = f"""
with oof as (select n_chars::double as score, toxic as label from labels join documents using (doc_id)), {roc_sql('oof')}"""


@query("roc_curve_rare_class", f"{DOC_CURVE} select thr as threshold, {ROUNDED_POINTS} from pts")
def roc_curve_rare_class(spark, sf):
    lengths = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labelled = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")).join(lengths, "doc_id")
    return rounded(curves.roc_curve(labelled), ["fpr", "tpr"])


AUC_COLUMNS = "round(auc, 6) as auc, round(auc - 0.01, 6) as auc_low, round(auc + 0.01, 6) as auc_high"
AUC_NAMES = ["auc", "auc_low", "auc_high"]


@query("auc", f"{BINARY_CURVE}, {auc_sql('pts')} select {AUC_COLUMNS} from areas")
def auc(spark, sf):
    return rounded(curves.auc(binary_cohort(spark, sf)), AUC_NAMES)


@query("auc_by_fold", f"{FOLD_CURVE}, {auc_sql('pts', 'fold')} select fold::int as fold, {AUC_COLUMNS} from areas where auc is not null")
def auc_by_fold(spark, sf):
    return rounded(curves.auc(staged_binary_oof(spark, sf), by=["fold"]), AUC_NAMES)


@query("auc_of_points", f"{LINE_CURVE}, {auc_sql('pts')} select round(auc, 6) as auc from areas")
def auc_of_points(spark, sf):
    return rounded(curves.auc_of_points(curves.roc_curve(_line_scores(spark, sf))), ["auc"])


def operating_point_sql(by: str | None = None) -> str:
    key = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""
    op as (select {key}min(thr) as threshold, round(arg_min(tpr, thr), 6) as sensitivity,
                  round(1 - arg_min(fpr, thr), 6) as specificity
           from pts where 1 - fpr >= 0.99 {group})"""


@query("threshold_at_specificity", f"{BINARY_CURVE}, {operating_point_sql()} select * from op")
def threshold_at_specificity(spark, sf):
    return rounded(curves.threshold_at_specificity(curves.roc_curve(binary_cohort(spark, sf))), ["sensitivity", "specificity"])


@query("threshold_at_specificity_by_fold", f"{FOLD_CURVE}, {operating_point_sql('fold')} select fold::int as fold, threshold, sensitivity, specificity from op")
def threshold_at_specificity_by_fold(spark, sf):
    points = curves.roc_curve(staged_binary_oof(spark, sf), by=["fold"])
    return rounded(curves.threshold_at_specificity(points, ["fold"]), ["sensitivity", "specificity"])


@query(
    "nearest_threshold",
    f"{BINARY_CURVE} select thr as threshold, {ROUNDED_POINTS} from pts order by abs(thr - 5000), thr desc limit 1",
)
def nearest_threshold(spark, sf):
    return rounded(curves.nearest_threshold(curves.roc_curve(binary_cohort(spark, sf)), 5000.0), ["fpr", "tpr"])


@query(
    "apply_threshold_pooled",
    f"{BINARY_CURVE}, {operating_point_sql()} select row_id, score, (score >= (select threshold from op))::int as called from oof",
)
def apply_threshold_pooled(spark, sf):
    cohort = binary_cohort(spark, sf)
    pooled = curves.threshold_at_specificity(curves.roc_curve(cohort))
    return curves.apply_threshold(cohort, pooled).select("row_id", "score", "called")


@query(
    "apply_threshold_by_fold",
    f"{FOLD_CURVE}, {operating_point_sql('fold')} select row_id, fold::int as fold, (score >= threshold)::int as called from oof join op using (fold)",
)
def apply_threshold_by_fold(spark, sf):
    oof = staged_binary_oof(spark, sf)
    per_fold = curves.threshold_at_specificity(curves.roc_curve(oof, by=["fold"]), ["fold"])
    return curves.apply_threshold(oof, per_fold, ["fold"]).select("row_id", "fold", "called")


def sensitivity_sql(group: str, called: str, z: str) -> str:
    return f"""
    s as (select {group}, count(*) filter (where {called} = 1) as detected, count(*) as total
          from called where label = 1 and {group} is not null group by {group}),
    r as (select *, detected::double / total as p from s)
    select {group}, detected, total, round(p, 6) as sensitivity, round({z} * sqrt(p * (1 - p) / total), 6) as error from r"""


@query(
    "sensitivity_by_class_fold_threshold",
    f"""{FOLD_CURVE}, {operating_point_sql('fold')},
        called as (select oof.*, (score >= threshold)::int as hit from oof join op using (fold)),
        {sensitivity_sql('"Condition"', 'hit', '1.96')}""",
)
def sensitivity_by_class_fold_threshold(spark, sf):
    oof = staged_binary_oof(spark, sf)
    per_fold = curves.threshold_at_specificity(curves.roc_curve(oof, by=["fold"]), ["fold"])
    hits = curves.apply_threshold(oof, per_fold, ["fold"])
    return rounded(evaluate.sensitivity_by(hits, "Condition", z=evaluate.NINETY_FIVE_PERCENT), ["sensitivity", "error"])


STAGED_CURVE = f"with {STAGED_OOF_SQL}, {roc_sql('oof')}, {operating_point_sql()}"


@query(
    "sensitivity_by_stage_pooled_threshold",
    f"""{STAGED_CURVE}, called as (select oof.*, (score >= (select threshold from op))::int as hit from oof),
        {sensitivity_sql('"Stage"', 'hit', '1.0')}""",
)
def sensitivity_by_stage_pooled_threshold(spark, sf):
    oof = staged_oof(spark, sf)
    pooled = curves.threshold_at_specificity(curves.roc_curve(oof))
    hits = curves.apply_threshold(oof, pooled)
    return rounded(evaluate.sensitivity_by(hits, "Stage"), ["sensitivity", "error"])


@query(
    "sensitivity_by_stage_prediction",
    f"with {STAGED_OOF_SQL}, called as (select * from oof), {sensitivity_sql(chr(34) + 'Stage' + chr(34), 'prediction', '1.0')}",
)
def sensitivity_by_stage_prediction(spark, sf):
    return rounded(evaluate.sensitivity_by(staged_oof(spark, sf), "Stage", called="prediction"), ["sensitivity", "error"])
