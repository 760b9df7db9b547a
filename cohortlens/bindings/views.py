"""The test tables in the roles the operators expect, in Spark and in SQL.

``customer`` plays a binary cohort (BUILDING is the normal class, the balance is the
score), ``orders`` a staged cohort, ``lineitem`` a wide measured table, ``embeddings`` a
typed cohort whose numbers, summed by place modulo ten, give class probabilities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.bindings.registry import table
from cohortlens.functions import vectors
from cohortlens.operators import clean, folds
from cohortlens.sources.schema import ASSAY_COLUMNS
from cohortlens.sources.staging import stage

NORMAL_SEGMENT = "BUILDING"
N_CLASSES = 10

# --- binary cohort ----------------------------------------------------------

BINARY_OOF_SQL = """
cohort as (
  select c_custkey as row_id, c_mktsegment as "Condition", c_nationkey, c_acctbal as score,
         case when c_mktsegment = 'BUILDING' then 0 else 1 end as label
  from customer),
oof as (
  select *, (row_number() over (order by label, md5(concat('42|', cast(row_id as varchar))), row_id) - 1) % 10 as fold,
         case when score >= 4500 then 1 else 0 end as prediction
  from cohort)
"""


def binary_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.col("c_mktsegment").alias("Condition"),
        "c_nationkey",
        F.col("c_acctbal").alias("score"),
    )
    return clean.binary_label(customers, normal=NORMAL_SEGMENT, out="label")


def binary_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = folds.stratified_folds(binary_cohort(spark, sf_dir), "label", "row_id")
    return split.withColumn("prediction", (F.col("score") >= 4500).cast("int"))


def staged_binary_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored cohort as a study leaves it: written once, then read by every report."""
    return stage(binary_oof(spark, sf_dir), "binary-oof")


# --- staged cohort ----------------------------------------------------------

STAGED_OOF_SQL = """
oof as (
  select o_orderkey as row_id, o_orderstatus as "Condition", o_orderpriority as "Stage", o_totalprice as score,
         case when o_orderstatus = 'O' then 0 else 1 end as label,
         case when o_totalprice >= 250000 then 1 else 0 end as prediction
  from orders)
"""


def staged_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("Condition"),
        F.col("o_orderpriority").alias("Stage"),
        F.col("o_totalprice").alias("score"),
    )
    labelled = clean.binary_label(orders, normal="O", out="label")
    return labelled.withColumn("prediction", (F.col("score") >= 250000).cast("int"))


# --- typed cohort -----------------------------------------------------------

TYPE_OOF_SQL = """
raw as (
  select vec_id as row_id, label,
         list_transform(range(0, 10), lambda c: list_sum(list_transform(list_filter(embedding, lambda v, i: (i - 1) % 10 = c), lambda v: cast(v as double)))) as logits
  from embeddings),
exped as (
  select row_id, label, logits, list_transform(logits, lambda v: exp(v - list_max(logits))) as e from raw),
probs as (
  select row_id, label, logits, list_transform(e, lambda v: v / list_sum(e)) as probs from exped),
oof as (
  select *, list_position(probs, list_max(probs)) - 1 as prediction,
         (row_number() over (order by label, md5(concat('42|', cast(row_id as varchar))), row_id) - 1) % 5 as fold
  from probs)
"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    place_sum = "aggregate(filter(embedding, (v, i) -> i % 10 = {c}), 0.0D, (total, v) -> total + cast(v as double))"
    sums = [F.expr(place_sum.format(c=c)) for c in range(N_CLASSES)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.array(*sums).alias("logits"))


def type_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = logits(spark, sf_dir).withColumn("probs", vectors.softmax(F.col("logits")))
    predicted = scored.withColumn("prediction", vectors.argmax(F.col("probs")))
    return folds.stratified_folds(predicted, "label", "row_id", k=folds.TYPE_TREE_FOLDS)


CLASS_LABELS = [f"class {i}" for i in range(N_CLASSES)]

# --- measured table ---------------------------------------------------------

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

DIRTY_SQL = """
dirty as (
  select l_orderkey, l_partkey, l_linenumber, l_returnflag,
         case when l_linenumber % 7 = 0 then 'n/a'
              else concat('**', cast(l_extendedprice as varchar)) end as price_text
  from lineitem),
cleaned as (
  select l_orderkey, l_partkey, l_linenumber, l_returnflag, try_cast(replace(price_text, '*', '') as double) as price
  from dirty)
"""


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("**"), F.col("l_extendedprice").cast("string"))
    price = F.when(F.col("l_linenumber") % 7 == 0, "n/a").otherwise(marked)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", price.alias("price")
    )


# --- assay cohort derived from the embeddings -------------------------------


MARKER = "Omega marker"
N_SUMS = 4


def assay_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw sample table: text assays with marks, a class with normals, a stage, an age.

    The numbers of a vector are assays, the last ones summed to a few further scores; one score, the
    marker, gives the class away, so that a sound model must predict it for every row. It stands twice, as
    trees look at a share of the features at each split and should hardly ever miss both.
    """
    panel = len(ASSAY_COLUMNS)
    star = "if(vec_id % 13 = {i} % 13, '*', '')"
    marked = [F.expr(f"concat({star.format(i=i)}, cast(exp(4.0D * embedding[{i}]) as string))") for i in range(panel)]
    rest = "aggregate(filter(embedding, (v, i) -> i >= {first} and i % {n} = {i}), 0.0D, (total, v) -> total + cast(v as double))"
    sums = [rest.format(first=panel, n=N_SUMS, i=i) for i in range(N_SUMS)]
    scores = [F.expr(f"concat({star.format(i=i)}, cast(exp({total}) as string))") for i, total in enumerate(sums)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("PatientID"),
        F.when(F.col("label") < 4, "Normal").when(F.col("label") < 6, "Lung").when(F.col("label") < 8, "Ovary")
        .otherwise("Breast").alias("Condition"),
        F.when(F.col("label") >= 4, F.element_at(F.array(F.lit("I"), F.lit("II"), F.lit("III")), (F.col("vec_id") % 3 + 1).cast("int"))).alias("Stage"),
        (40 + F.col("vec_id") % 40).cast("string").alias("Age"),
        *[m.alias(name) for m, name in zip(marked, ASSAY_COLUMNS)],
        *[score.alias(f"Omega {i}") for i, score in enumerate(scores)],
        (F.col("label") + 1).cast("string").alias(MARKER),
        (F.col("label") + 1).cast("string").alias("Omega second marker"),
    )
