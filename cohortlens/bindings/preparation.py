"""Cleaning, labelling and scaling on customers and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.bindings.registry import query, rounded, table
from cohortlens.bindings.views import DIRTY_SQL, LINE_FEATURES, NORMAL_SEGMENT, TYPE_OOF_SQL, dirty_lines, logits
from cohortlens.functions import vectors
from cohortlens.operators import clean, scale


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *LINE_FEATURES)


def _cleaned(spark, sf):
    return clean.clean_numeric(dirty_lines(spark, sf), ["price"])


@query("clean_numeric", f"with {DIRTY_SQL} select * from cleaned")
def clean_numeric(spark, sf):
    return _cleaned(spark, sf)


@query(
    "log2_normalize_negative_minimum",
    "select c_custkey, round(log2(c_acctbal + abs(min(c_acctbal) over ()) + 1), 6) as c_acctbal from customer",
)
def log2_normalize_negative_minimum(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale.log2_normalize(customers, ["c_acctbal"]), ["c_acctbal"])


@query(
    "log2_normalize",
    """select l_orderkey, l_partkey, l_linenumber, round(log2(l_quantity), 6) as l_quantity,
              round(log2(l_extendedprice), 6) as l_extendedprice, round(log2(l_discount + 1), 6) as l_discount,
              l_tax from lineitem""",
)
def log2_normalize(spark, sf):
    normal = scale.log2_normalize(_lines(spark, sf), LINE_FEATURES, exclude=["l_tax"])
    return rounded(normal, LINE_FEATURES[:3])


@query(
    "fill_median",
    f"""with {DIRTY_SQL}
        select l_orderkey, l_partkey, l_linenumber, l_returnflag,
               coalesce(price, (select median(price) from cleaned)) as price from cleaned""",
)
def fill_median(spark, sf):
    return scale.fill_median(_cleaned(spark, sf), ["price"])


@query(
    "column_medians",
    """select 'l_quantity' as column_name, median(l_quantity) as median from lineitem
       union all select 'l_extendedprice', median(l_extendedprice) from lineitem
       union all select 'l_discount', median(l_discount) from lineitem
       union all select 'l_tax', median(l_tax) from lineitem""",
)
def column_medians(spark, sf):
    medians = scale.fit_medians(_lines(spark, sf), LINE_FEATURES)
    return spark.createDataFrame(list(medians.items()), "column_name string, median double")


@query(
    "median_of_cells",
    """select median(v) as median from (select l_quantity as v from lineitem union all select l_extendedprice from lineitem
       union all select l_discount from lineitem union all select l_tax from lineitem)""",
)
def median_of_cells(spark, sf):
    return spark.createDataFrame([(scale.median_of_cells(_lines(spark, sf), LINE_FEATURES),)], "median double")


@query("drop_missing", f"with {DIRTY_SQL} select * from cleaned where price is not null")
def drop_missing(spark, sf):
    return clean.drop_missing(_cleaned(spark, sf), ["price"])


@query(
    "binary_label",
    """with t as (select c_custkey, case when c_nationkey = 0 then null else c_mktsegment end as "Condition" from customer)
       select c_custkey, "Condition", (case when "Condition" = 'BUILDING' then 0 else 1 end)::int as binary_condition from t""",
)
def binary_label(spark, sf):
    segment = F.when(F.col("c_nationkey") != 0, F.col("c_mktsegment")).alias("Condition")
    return clean.binary_label(table(spark, sf, "customer").select("c_custkey", segment), normal=NORMAL_SEGMENT)


@query(
    "binary_label_counts",
    """select (case when c_mktsegment = 'BUILDING' then 0 else 1 end)::int as binary_condition, count(*) as n
       from customer group by 1""",
)
def binary_label_counts(spark, sf):
    labelled = clean.binary_label(table(spark, sf, "customer"), "c_mktsegment", NORMAL_SEGMENT)
    return labelled.groupBy("binary_condition").agg(F.count(F.lit(1)).alias("n"))


@query(
    "project_features",
    """select c_custkey as row_id, [c_acctbal, c_acctbal * 2, cast(c_nationkey as double)] as features from customer""",
)
def project_features(spark, sf):
    samples = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.col("c_mktsegment").alias("Condition"),
        F.col("c_nationkey").alias("Age"),
        (F.col("c_acctbal") * 2).alias("Omega score"),
        F.col("c_acctbal").alias("AFP (pg/ml)"),
    )
    names = clean.feature_columns(samples.columns, use_age=True)
    return samples.select("row_id", clean.feature_array(names).alias("features"))


@query(
    "encode_labels",
    """with codes as (select m, (dense_rank() over (order by m) - 1)::int as label from (select distinct c_mktsegment as m from customer))
       select c_custkey, c_mktsegment, label from customer join codes on m = c_mktsegment""",
)
def encode_labels(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return clean.encode_labels(customers, clean.fit_label_codes(customers, "c_mktsegment"))


@query("decode_labels", "select c_custkey, c_mktsegment as decoded from customer")
def decode_labels(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    codes = clean.fit_label_codes(customers, "c_mktsegment")
    coded = clean.encode_labels(customers, codes)
    return clean.decode_labels(coded, "label", codes.labels, "decoded").select("c_custkey", "decoded")


@query(
    "standardize",
    """select l_orderkey, l_partkey, l_linenumber,
              round((l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over (), 6) as l_quantity,
              round((l_extendedprice - avg(l_extendedprice) over ()) / stddev_pop(l_extendedprice) over (), 6) as l_extendedprice,
              round((l_discount - avg(l_discount) over ()) / stddev_pop(l_discount) over (), 6) as l_discount,
              round((l_tax - avg(l_tax) over ()) / stddev_pop(l_tax) over (), 6) as l_tax
       from lineitem""",
)
def standardize(spark, sf):
    return rounded(scale.standardize(_lines(spark, sf), LINE_FEATURES), LINE_FEATURES)


@query(
    "standardize_new_rows",
    """with p as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s from customer)
       select s_suppkey, round((s_acctbal - (select m from p)) / (select s from p), 6) as balance from supplier""",
)
def standardize_new_rows(spark, sf):
    known = table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance"))
    new = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"))
    return rounded(scale.apply_standardize(new, scale.fit_standardize(known, ["balance"])), ["balance"])


@query("exclude_class", "select * from customer where c_mktsegment is distinct from 'BUILDING'")
def exclude_class(spark, sf):
    return clean.exclude_class(table(spark, sf, "customer"), "c_mktsegment", NORMAL_SEGMENT)


@query(
    "nan_to_zero",
    f"""with {TYPE_OOF_SQL} select row_id, list_transform(logits, lambda v: case when v < 0 then 0.0::double else v end) as z from raw""",
)
def nan_to_zero(spark, sf):
    gaps = F.transform("logits", lambda v: F.when(v < -0.1, float("nan")).when(v >= 0, v))
    return logits(spark, sf).select("row_id", vectors.nan_to_zero(gaps).alias("z"))


@query(
    "class_name",
    "select c_custkey, case when c_mktsegment = 'BUILDING' then 'Normal' else 'Cancer' end as predicted_class from customer",
)
def class_name(spark, sf):
    labelled = clean.binary_label(table(spark, sf, "customer"), "c_mktsegment", NORMAL_SEGMENT, "prediction")
    return labelled.select("c_custkey", clean.class_name(F.col("prediction")).alias("predicted_class"))
