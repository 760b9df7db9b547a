"""Folds, weights and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.bindings.registry import query, rounded, table
from cohortlens.bindings.views import BINARY_OOF_SQL, TYPE_OOF_SQL, binary_cohort, binary_oof, type_oof
from cohortlens.operators import folds


@query("stratified_folds", f"with {BINARY_OOF_SQL} select row_id, label::int as label, fold::int as fold from oof")
def stratified_folds(spark, sf):
    return binary_oof(spark, sf).select("row_id", "label", "fold")


@query(
    "stratified_folds_by_status",
    """select o_orderkey, o_orderstatus, ((row_number() over (order by o_orderstatus,
              md5(concat('7|', cast(o_orderkey as varchar))), o_orderkey) - 1) % 5)::int as fold from orders""",
)
def stratified_folds_by_status(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return folds.stratified_folds(orders, "o_orderstatus", "o_orderkey", k=5, seed=7)


@query("train_split", f"with {BINARY_OOF_SQL} select row_id, fold::int as fold from oof where fold <> 3")
def train_split(spark, sf):
    return folds.train_split(binary_oof(spark, sf).select("row_id", "fold"), 3)


@query("test_split", f"with {BINARY_OOF_SQL} select row_id, fold::int as fold from oof where fold = 3")
def test_split(spark, sf):
    return folds.test_split(binary_oof(spark, sf).select("row_id", "fold"), 3)


@query(
    "fold_class_distribution",
    f"""with {TYPE_OOF_SQL}
        select t.fold::int as fold, o.label, count(*) as train_rows
        from (select distinct fold from oof) t join oof o on o.fold <> t.fold group by 1, 2""",
)
def fold_class_distribution(spark, sf):
    return folds.fold_class_distribution(type_oof(spark, sf), "label", k=5)


BALANCED_SQL = """
weights as (
  select quality, (select count(*) from labels)::double / ((select count(distinct quality) from labels) * count(*)) as weight
  from labels group by quality)
"""


@query("balanced_weights", f"with {BALANCED_SQL} select quality, round(weight, 6) as weight from weights")
def balanced_weights(spark, sf):
    return rounded(folds.balanced_weights(table(spark, sf, "labels"), "quality"), ["weight"])


@query(
    "attach_weights",
    f"""with {BALANCED_SQL}
        select doc_id, labels.quality, toxic, round(weight, 6) as weight
        from labels left join weights on weights.quality = labels.quality""",
)
def attach_weights(spark, sf):
    labels = table(spark, sf, "labels")
    return rounded(folds.attach_weights(labels, folds.balanced_weights(labels, "quality"), "quality"), ["weight"])


@query(
    "positive_weight",
    """select round(count(*) filter (where toxic = 0)::double / count(*) filter (where toxic = 1), 6) as pos_weight from labels""",
)
def positive_weight(spark, sf):
    return rounded(folds.positive_weight(table(spark, sf, "labels"), "toxic"), ["pos_weight"])


@query(
    "sample_n",
    "select c_custkey, c_acctbal from customer order by md5(concat('42|', cast(c_custkey as varchar))), c_custkey limit 200",
)
def sample_n(spark, sf):
    return folds.sample_n(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), 200, "c_custkey")
