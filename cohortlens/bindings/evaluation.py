"""Metrics, rankings and reports over given predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.bindings.registry import query, rounded, rounded_array, table
from cohortlens.bindings.views import (
    BINARY_OOF_SQL,
    CLASS_LABELS,
    STAGED_OOF_SQL,
    TYPE_OOF_SQL,
    binary_oof,
    logits,
    staged_oof,
    type_oof,
)
from cohortlens.functions import vectors
from cohortlens.operators import evaluate, folds, ranking

TYPE = f"with {TYPE_OOF_SQL}"
BINARY = f"with {BINARY_OOF_SQL}"
ACCURACY_SQL = "acc as (select fold, avg((prediction = label)::int) as accuracy from oof group by fold)"


@query("predict_class", f"{TYPE} select row_id, list_transform(probs, lambda v: round(v, 6)) as probs, prediction::int as prediction from oof")
def predict_class(spark, sf):
    scored = logits(spark, sf).withColumn("probs", vectors.softmax(F.col("logits")))
    return scored.select("row_id", rounded_array(F.col("probs")).alias("probs"), vectors.argmax(F.col("probs")).alias("prediction"))


@query("positive_class_score", f"{TYPE} select row_id, round(probs[2], 6) as score from oof")
def positive_class_score(spark, sf):
    scored = logits(spark, sf).withColumn("probs", vectors.softmax(F.col("logits")))
    return rounded(scored.select("row_id", vectors.element(F.col("probs"), 1).alias("score")), ["score"])


@query(
    "one_vs_rest_probabilities",
    f"""{TYPE}, s as (select row_id, list_transform(logits, lambda v: 1 / (1 + exp(-2 * v))) as s from oof)
        select row_id, list_transform(s, lambda v: round(v / list_sum(s), 6)) as probs from s""",
)
def one_vs_rest_probabilities(spark, sf):
    return logits(spark, sf).select(
        "row_id", rounded_array(vectors.one_vs_rest_probabilities(F.col("logits"))).alias("probs")
    )


RANKED_SQL = """
cells as (select row_id, label, unnest(probs) as p, generate_subscripts(probs, 1) - 1 as idx from oof),
ranked as (select *, row_number() over (partition by row_id order by p desc, idx) as rnk from cells),
tops as (select row_id, any_value(label) as label, list(idx::int order by rnk) as top from ranked where rnk <= 2 group by row_id)
"""


@query("top_k_classes", f"{TYPE}, {RANKED_SQL} select row_id, top from tops")
def top_k_classes(spark, sf):
    return type_oof(spark, sf).select("row_id", vectors.top_k(F.col("probs"), 2).alias("top"))


@query(
    "top_k_labels",
    f"""{TYPE}, {RANKED_SQL}
        select row_id, list('class ' || idx order by rnk) as top_labels, list(round(p, 6) order by rnk) as top_probabilities
        from ranked where rnk <= 2 group by row_id""",
)
def top_k_labels(spark, sf):
    classes = F.array(*[F.lit(c) for c in CLASS_LABELS])
    top = type_oof(spark, sf).withColumn("top", vectors.top_k(F.col("probs"), 2))
    return top.select(
        "row_id",
        vectors.gather(classes, F.col("top")).alias("top_labels"),
        rounded_array(vectors.gather(F.col("probs"), F.col("top"))).alias("top_probabilities"),
    )


@query("in_top_k", f"{TYPE}, {RANKED_SQL} select row_id, label, list_contains(top, label) as hit from tops")
def in_top_k(spark, sf):
    return type_oof(spark, sf).select("row_id", "label", vectors.in_top_k(F.col("label"), F.col("probs"), 2).alias("hit"))


@query("accuracy_by_fold", f"{TYPE}, {ACCURACY_SQL} select fold::int as fold, round(accuracy, 6) as accuracy from acc")
def accuracy_by_fold(spark, sf):
    return rounded(evaluate.accuracy_by_fold(type_oof(spark, sf)), ["accuracy"])


@query("mean_std", f"{BINARY}, {ACCURACY_SQL} select round(avg(accuracy), 6) as mean, round(stddev_pop(accuracy), 6) as std from acc")
def mean_std(spark, sf):
    return rounded(evaluate.mean_std(evaluate.accuracy_by_fold(binary_oof(spark, sf)), "accuracy"), ["mean", "std"])


@query("best_fold", f"{BINARY}, {ACCURACY_SQL} select fold::int as fold, round(accuracy, 6) as accuracy from acc order by acc.accuracy desc, fold limit 1")
def best_fold(spark, sf):
    return rounded(evaluate.best_fold(evaluate.accuracy_by_fold(binary_oof(spark, sf))), ["accuracy"])


@query("confusion_counts", f"{TYPE} select label, prediction::int as prediction, count(*) as n from oof group by 1, 2")
def confusion_counts(spark, sf):
    return evaluate.confusion_counts(type_oof(spark, sf))


@query(
    "confusion_matrix",
    f"{TYPE} select label, "
    + ", ".join(f'count(*) filter (where prediction = {c}) as "{c}"' for c in range(10))
    + " from oof group by label",
)
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(type_oof(spark, sf), list(range(10)))


@query(
    "confusion_cells",
    f"""with {STAGED_OOF_SQL}
        select count(*) filter (where label = 0 and prediction = 0) as true_negative,
               count(*) filter (where label = 0 and prediction = 1) as false_positive,
               count(*) filter (where label = 1 and prediction = 0) as false_negative,
               count(*) filter (where label = 1 and prediction = 1) as true_positive from oof""",
)
def confusion_cells(spark, sf):
    return evaluate.confusion_cells(staged_oof(spark, sf))


REPORT_SQL = """
cls as (select label as c from oof union select prediction from oof),
base as (select c, (select count(*) from oof where label = c and prediction = c) as tp,
                (select count(*) from oof where prediction = c) as pn,
                (select count(*) from oof where label = c) as support from cls),
pr as (select *, case when pn = 0 then 0 else tp::double / pn end as precision,
              case when support = 0 then 0 else tp::double / support end as recall from base),
f as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from pr),
report as (
  select cast(c as varchar) as class, precision, recall, f1, support from f
  union all select 'accuracy', sum(tp)::double / sum(support), sum(tp)::double / sum(support), sum(tp)::double / sum(support), sum(support)::bigint from f
  union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::bigint from f
  union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support)::bigint from f)
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from report
"""


@query("classification_report", f"{TYPE}, {REPORT_SQL}")
def classification_report(spark, sf):
    return rounded(evaluate.classification_report(type_oof(spark, sf)), ["precision", "recall", "f1"])


@query("classification_report_binary", f"with {STAGED_OOF_SQL}, {REPORT_SQL}")
def classification_report_binary(spark, sf):
    return rounded(evaluate.classification_report(staged_oof(spark, sf)), ["precision", "recall", "f1"])


BY_CLASS_SQL = f"""
{RANKED_SQL},
hits as (select t.row_id, t.label, o.prediction = o.label as one, list_contains(top, t.label) as two from tops t join oof o using (row_id)),
byclass as (select i::int as label, 'class ' || i as class, count(h.row_id) as total, count(*) filter (where one) as top1_correct,
                   count(*) filter (where two) as top2_correct
            from range(12) r(i) left join hits h on h.label = i group by i),
rates as (select *, case when total = 0 then 0 else top1_correct::double / total end as top1,
                 case when total = 0 then 0 else top2_correct::double / total end as top2 from byclass),
errs as (select *, case when total = 0 then 0 else 1.96 * sqrt(top2 * (1 - top2) / total) end as error from rates)
"""
TWELVE = [f"class {i}" for i in range(12)]


@query(
    "topk_accuracy_by_class",
    f"""{TYPE}, {BY_CLASS_SQL} select label, class, total, top1_correct, top2_correct, round(top1, 6) as top1,
        round(top2, 6) as top2, round(error, 6) as error from errs""",
)
def topk_accuracy_by_class(spark, sf):
    by_class = evaluate.topk_accuracy_by_class(type_oof(spark, sf), TWELVE)
    return rounded(by_class, ["top1", "top2", "error"])


@query(
    "topk_stack",
    f"""{TYPE}, {BY_CLASS_SQL} select class, round(100.0::double * top1, 6) as top1_pct,
        round(100.0::double * (top2 - top1), 6) as top2_only_pct, round(100.0::double * error, 6) as error_pct from errs""",
)
def topk_stack(spark, sf):
    by_class = evaluate.topk_accuracy_by_class(type_oof(spark, sf), TWELVE)
    return rounded(evaluate.topk_stack(by_class, order=["CLASS 7", "class 2"]), ["top1_pct", "top2_only_pct", "error_pct"])


@query(
    "custom_order",
    """with c as (select c_mktsegment as segment, count(*) as n from customer group by 1),
       o as (select unnest(['machinery', 'Building']) as name, unnest([0, 1]) as pos)
       select segment, n, pos::int as place from c left join o on lower(o.name) = lower(c.segment)""",
)
def custom_order(spark, sf):
    counts = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    ordered = evaluate.custom_order(counts, "segment", order=["machinery", "Building"])
    return ordered.withColumn("place", evaluate.class_position(F.col("segment"), ["machinery", "Building"]))


@query("pool_oof", f"{BINARY} select row_id, fold::int as fold, label::int as label, prediction::int as prediction, score from oof")
def pool_oof(spark, sf):
    oof = binary_oof(spark, sf).select("row_id", "fold", "label", "prediction", "score")
    return evaluate.pool_oof([folds.test_split(oof, i) for i in range(10)])


@query(
    "attach_predictions",
    f"""with {STAGED_OOF_SQL} select o_orderkey as row_id, o_custkey, o_orderpriority, prediction::int as prediction, score
        from orders join oof on row_id = o_orderkey""",
)
def attach_predictions(spark, sf):
    samples = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderpriority")
    return evaluate.attach_predictions(samples, staged_oof(spark, sf).select("row_id", "prediction", "score"))


# --- rankings ---------------------------------------------------------------

IMPORTANCE_SQL = "imp as (select p_name as feature, avg(p_retailprice) as importance from part group by 1)"


def _importance(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))


@query("top_n_features", f"with {IMPORTANCE_SQL} select feature, round(importance, 6) as importance from imp order by imp.importance desc, feature limit 20")
def top_n_features(spark, sf):
    return rounded(ranking.top_n_features(_importance(spark, sf)), ["importance"])


@query(
    "top_n_per_group",
    """with i as (select p_size as class, p_name as feature, avg(p_retailprice) as importance from part group by 1, 2),
       r as (select *, row_number() over (partition by class order by importance desc, feature) as rank from i where class < 5)
       select class, feature, round(importance, 6) as importance, rank::int as rank from r where rank <= 10""",
)
def top_n_per_group(spark, sf):
    by_class = (
        table(spark, sf, "part")
        .groupBy(F.col("p_size").alias("class"), F.col("p_name").alias("feature"))
        .agg(F.avg("p_retailprice").alias("importance"))
    )
    return rounded(ranking.top_n_per_group(ranking.first_classes(by_class), "class"), ["importance"])
