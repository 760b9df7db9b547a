"""Latent-model scorers and attributions with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.bindings.registry import query, rounded, table
from cohortlens.functions import vectors
from cohortlens.operators import coalitions, explain, folds, latent, ranking

BATCH_SQL = """
batch as (
  select vec_id as row_id, label::int as label,
         list_transform(embedding[1:18], lambda v: v::double) as x, list_transform(embedding[19:36], lambda v: v::double) as x_recon,
         list_transform(embedding[37:45], lambda v: v::double) as mu, list_transform(embedding[46:54], lambda v: v::double) as log_var,
         list_transform(embedding[55:64], lambda v: v::double) as logits
  from embeddings),
parts as (
  select row_id,
         list_sum(list_transform(range(1, 19), lambda i: pow(x[i] - x_recon[i], 2))) as recon,
         -0.5 * list_sum(list_transform(range(1, 10), lambda i: 1 + log_var[i] - pow(mu[i], 2) - exp(log_var[i]))) as kl,
         ln(list_sum(list_transform(logits, lambda v: exp(v)))) - logits[label + 1] as cls
  from batch),
losses as (select *, recon + 5.0::double * kl + 20.0::double * cls as loss from parts)
"""


def latent_batch(spark, sf):
    def part(first: int, n: int):
        return F.transform(F.slice("embedding", first, n), lambda v: v.cast("double"))

    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        "label",
        part(1, 18).alias("x"),
        part(19, 18).alias("x_recon"),
        part(37, 9).alias("mu"),
        part(46, 9).alias("log_var"),
        part(55, 10).alias("logits"),
    )


@query("recon_error", f"with {BATCH_SQL} select row_id, round(recon, 6) as recon_error from parts")
def recon_error(spark, sf):
    return rounded(latent.recon_error(latent_batch(spark, sf)).select("row_id", "recon_error"), ["recon_error"])


PARTS = ["loss", "recon", "kl", "cls"]


@query("loss_parts", f"with {BATCH_SQL} select row_id, {', '.join(f'round({p}, 6) as {p}' for p in PARTS)} from losses")
def loss_parts(spark, sf):
    return rounded(latent.loss_parts(latent_batch(spark, sf)).select("row_id", *PARTS), PARTS)


AVERAGES = [f"avg_{p}" for p in PARTS]


@query(
    "joint_loss",
    f"""with {BATCH_SQL} select count(*) as n, {', '.join(f'round(sum({p}), 6) as {p}' for p in PARTS)},
        {', '.join(f'round(avg({p}), 6) as avg_{p}' for p in PARTS)} from losses""",
)
def joint_loss(spark, sf):
    return rounded(latent.joint_loss(latent_batch(spark, sf)), [*PARTS, *AVERAGES])


# --- attributions -----------------------------------------------------------
# For a linear score the attribution of a feature is weight * (value - background mean),
# whatever the feature orders, so SQL can state the answer.

WEIGHTS = {"l_quantity": 2.0, "l_discount": -30.0, "l_tax": 10.0, "o_totalprice": 0.00137913}

SAMPLE_SQL = """
lines as (
  select o_orderkey as row_id, o_totalprice, sum(l_quantity) as l_quantity, sum(l_discount) as l_discount, sum(l_tax) as l_tax
  from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
background as (select * from lines order by md5(concat('42|', cast(row_id as varchar))), row_id limit 100),
explained as (select * from lines order by md5(concat('43|', cast(row_id as varchar))), row_id limit 200),
long as (
  select row_id, 'l_quantity' as feature, l_quantity as value, 2.0::double * (l_quantity - (select avg(l_quantity) from background)) as phi from explained
  union all
  select row_id, 'l_discount', l_discount, -30.0::double * (l_discount - (select avg(l_discount) from background)) from explained
  union all
  select row_id, 'l_tax', l_tax, 10.0::double * (l_tax - (select avg(l_tax) from background)) from explained
  union all
  select row_id, 'o_totalprice', o_totalprice, 0.00137913::double * (o_totalprice - (select avg(o_totalprice) from background)) from explained),
base as (
  select avg(2 * l_quantity - 30 * l_discount + 10 * l_tax + 0.00137913::double * o_totalprice) as base from background),
phis as (
  select row_id, c as class, feature, value, case when c = 0 then phi else -phi end as phi,
         case when c = 0 then base else 1 - base end as base
  from long, base, (select unnest([0, 1]) as c))
"""


def linear_score(df):
    total = F.lit(0.0)
    for i, w in enumerate(WEIGHTS.values()):
        total = total + F.lit(w) * F.get("x", F.lit(i))
    return df.withColumn("scores", F.array(total, 1.0 - total))


def order_measures(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        *[F.sum(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")]
    )
    prices = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    return prices.join(lines, "row_id")


def attributions(spark, sf, method=explain.shapley_attributions):
    rows = order_measures(spark, sf)
    background = folds.sample_n(rows, explain.BACKGROUND_ROWS, "row_id", 42)
    explained = folds.sample_n(rows, explain.EXPLAINED_ROWS, "row_id", 43)
    return method(explained, list(WEIGHTS), linear_score, background)


ATTRIBUTIONS_SQL = f"""with {SAMPLE_SQL} select row_id, class::int as class, feature, round(value, 6) as value, round(phi, 6) as phi,
        round(base, 6) as base from phis"""


@query("shapley_attributions", ATTRIBUTIONS_SQL)
def shapley_attributions(spark, sf):
    return rounded(attributions(spark, sf), ["value", "phi", "base"])


@query("kernel_attributions", ATTRIBUTIONS_SQL)
def kernel_attributions(spark, sf):
    return rounded(attributions(spark, sf, coalitions.kernel_attributions), ["value", "phi", "base"])


@query("shap_ranking", f"with {SAMPLE_SQL} select feature, round(avg(abs(phi)), 6) as importance from phis group by feature")
def shap_ranking(spark, sf):
    return rounded(explain.shap_ranking(attributions(spark, sf)), ["importance"])


@query(
    "class_shap_ranking",
    f"""with {SAMPLE_SQL}, i as (select class, feature, avg(abs(phi)) as importance from phis group by 1, 2),
        r as (select *, row_number() over (partition by class order by importance desc, feature) as rank from i)
        select class::int as class, feature, round(importance, 6) as importance, rank::int as rank from r where rank <= 3""",
)
def class_shap_ranking(spark, sf):
    per_class = explain.class_shap_ranking(attributions(spark, sf))
    return rounded(ranking.top_n_per_group(per_class, "class", n=3), ["importance"])


# Given attributions: the numbers of the embeddings as contributions of 64 features.

GIVEN_SQL = """
given as (select vec_id as row_id, 'feature ' || (i - 1) as feature, embedding[i]::double as phi, i::double as value, 0.5::double as base
          from embeddings, range(1, 65) r(i))
"""


def given_attributions(spark, sf):
    cells = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("i", "v"))
    return cells.select(
        "row_id",
        F.concat(F.lit("feature "), F.col("i").cast("string")).alias("feature"),
        F.col("v").cast("double").alias("phi"),
        (F.col("i") + 1).cast("double").alias("value"),
        F.lit(0.5).alias("base"),
    )


@query(
    "argmax_row_per_feature",
    f"""with {GIVEN_SQL}, r as (select *, row_number() over (partition by feature order by abs(phi) desc, row_id) as n from given)
        select feature, row_id, round(abs(phi), 6) as abs_phi from r where n = 1""",
)
def argmax_row_per_feature(spark, sf):
    return rounded(ranking.argmax_row_per_feature(given_attributions(spark, sf)), ["abs_phi"])


@query(
    "waterfall_rows",
    f"""with {GIVEN_SQL}, one as (select *, row_number() over (order by abs(phi) desc, feature) as place from given where row_id = 7)
        select least(place, 10)::int as rank, case when place < 10 then feature else 'other' end as feature,
               max(case when place < 10 then value end) as value, round(sum(phi), 6) as phi, max(base) as base
        from one group by 1, 2""",
)
def waterfall_rows(spark, sf):
    return rounded(explain.waterfall_rows(given_attributions(spark, sf), 7), ["phi"])


@query(
    "dependence_rows",
    f"with {GIVEN_SQL} select feature, row_id, value, phi from given where feature in ('feature 3', 'feature 60')",
)
def dependence_rows(spark, sf):
    return explain.dependence_rows(given_attributions(spark, sf), ["feature 3", "feature 60"])
