"""Model fits, scoring and studies at full budget, on tables whose answer SQL knows.

Fitted numbers have no SQL form, but a sound model of a separable table must predict every label,
so the tables hold a feature that gives the label away among features that tell nothing, and SQL
states the prediction of every row. Fits are kept for the session: several queries read one.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohortlens.bindings.registry import query, rounded, table
from cohortlens.bindings.views import MARKER, N_SUMS
from cohortlens.bindings.views import assay_cohort as assay_view
from cohortlens.functions import vectors
from cohortlens.operators import boosting, clean, curves, explain, folds, joint, latent, models, neighbours, scoring
from cohortlens.operators.preprocess import fit_preprocessing
from cohortlens.plans.binary import run_binary
from cohortlens.plans.common import FIT_TASK_ROWS, prepare_cohort, validate
from cohortlens.plans.latent import EXPLAINED_SEED, run_latent
from cohortlens.plans.profiling import profile_cohort
from cohortlens.plans.types import run_type
from cohortlens.plans.writing import write_study
from cohortlens.sources.bundle import ModelBundle, load_bundle, save_bundle
from cohortlens.sources.schema import ASSAY_COLUMNS
from cohortlens.sources.staging import scratch_path, stage

# Fits at a time, and least tasks of each; more follow from the rows.
FITS_AT_ONCE, FIT_TASKS = 4, 2


def fit_tasks(rows) -> int:
    """Tasks a fit needs at most, by the number of rows; a large table keeps the partitions of its scan."""
    return max(FIT_TASKS, rows.count() // FIT_TASK_ROWS)


def once(build):
    """Keep what ``build(spark, sf)`` returns for the session."""

    @lru_cache(maxsize=None)
    def kept(_application: str, sf: str):
        return build(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), sf)

    return lambda spark, sf: kept(spark.sparkContext.applicationId, sf)


# The raw sample table as a job finds it: a file, not a chain of expressions.
assay_cohort = once(lambda spark, sf: stage(assay_view(spark, sf), "samples"))

# --- customers: the nation gives the label away ------------------------------

CUSTOMER_FEATURES = ["c_acctbal", "c_nationkey", "c_custkey % 7"]
BINARY_LABEL, TYPE_LABEL = "(c_nationkey >= 12)::int", "(c_nationkey // 9)::int"


def _customers(spark, sf, label, k):
    customers = table(spark, sf, "customer").withColumn("c_custkey % 7", F.col("c_custkey") % 7)
    ready = VectorAssembler(inputCols=CUSTOMER_FEATURES, outputCol="features").transform(customers)
    rows = ready.select(F.col("c_custkey").alias("row_id"), label.cast("int").alias("label"), "features")
    return stage(folds.stratified_folds(rows, "label", "row_id", k=k), "customers", partition_by="fold")


@once
def binary_rows(spark, sf):
    return _customers(spark, sf, F.col("c_nationkey") >= 12, folds.BINARY_FOLDS)


@once
def typed_rows(spark, sf):
    return _customers(spark, sf, F.floor(F.col("c_nationkey") / 9), folds.TYPE_TREE_FOLDS)


def separable_sql(label: str, k: int | None = None) -> str:
    """Key, label and the prediction any sound model makes; with the fold of the shuffled split."""
    fold = f""", ((row_number() over (order by {label}, md5(concat('42|', cast(c_custkey as varchar))), c_custkey) - 1) % {k})::int as fold"""
    return f"select c_custkey as row_id, {label} as label, {label} as prediction{fold if k else ''} from customer"


@once
def binary_model(spark, sf):
    rows = binary_rows(spark, sf)
    return models.fit_boosted_binary(rows.coalesce(fit_tasks(rows)), folds.positive_weight(rows).first()["pos_weight"])


@query("fit_boosted_binary", separable_sql(BINARY_LABEL))
def fit_boosted_binary(spark, sf):
    return models.score_binary(binary_model(spark, sf), binary_rows(spark, sf)).select("row_id", "label", "prediction")


@query("fit_boosted_multi", separable_sql(TYPE_LABEL))
def fit_boosted_multi(spark, sf):
    rows = typed_rows(spark, sf)
    return models.score_boosted_multi(models.fit_boosted_multi(rows.coalesce(fit_tasks(rows))), rows).select("row_id", "label", "prediction")


@query("fit_boosted_multi_weighted", separable_sql(TYPE_LABEL))
def fit_boosted_multi_weighted(spark, sf):
    rows = typed_rows(spark, sf)
    return models.score_boosted_multi(models.fit_boosted_multi(rows.coalesce(fit_tasks(rows)), weighted=True), rows).select("row_id", "label", "prediction")


@once
def boosted_folds(spark, sf):
    rows = binary_rows(spark, sf)
    *fitted, _ = models.fit_binary_folds(rows.coalesce(fit_tasks(rows)), folds.BINARY_FOLDS)
    return models.score_folds(rows, fitted, models.score_binary)


@query("cross_validate_boosted", separable_sql(BINARY_LABEL, folds.BINARY_FOLDS))
def cross_validate_boosted(spark, sf):
    return boosted_folds(spark, sf).oof.select("row_id", "label", "prediction", "fold")


@query("fit_final", separable_sql(BINARY_LABEL))
def fit_final(spark, sf):
    """The model of all rows keeps the predictions of the folds."""
    final = models.score_binary(binary_model(spark, sf), binary_rows(spark, sf)).select("row_id", "label", "prediction")
    return final.join(boosted_folds(spark, sf).oof.select("row_id", "prediction"), ["row_id", "prediction"]).select("row_id", "label", "prediction")


# --- one round, stated by SQL ----------------------------------------------------

ROUND_FEATURES = ["c_nationkey", "c_custkey % 7"]
ONE_ROUND = boosting.Boosting(rounds=1, depth=1, step=0.05, row_share=1.0, column_share=1.0, min_weight=2.0, gamma=0.1, l1=0.5, l2=10.0)


def round_sql(label: str, classes: int, p: str, h: str) -> str:
    """The best first split of every class: all rows have probability ``p`` and second derivative ``h``."""
    soft = "sign({0}) * greatest(abs({0}) - 0.5, 0)"
    part = "power(" + soft + ", 2) / ({1} + 10.0)"
    gain = f"{part.format('gl', 'hl')} + {part.format('g - gl', 'h - hl')} - {part.format('g', 'h')}"
    leaf = "round(-0.05 * " + soft + " / ({1} + 10.0), 6)"
    return f"""
with r as (select c_nationkey::double as f0, (c_custkey % 7)::double as f1, {label} as label from customer),
x as (select 0 as f, f0 as v, label from r union all select 1, f1, label from r),
cells as (select c.c, f, v, sum({p} - (label = c.c)::int) as g, count(*) * {h} as h from x, range({2 if classes == 1 else 0}, {classes if classes > 1 else 3}) t(c0), lateral (select {'1' if classes == 1 else 'c0'} as c) c group by 1, 2, 3),
cut as (select c, f, v, sum(g) over w as gl, sum(h) over w as hl, sum(g) over (partition by c, f) as g, sum(h) over (partition by c, f) as h
        from cells window w as (partition by c, f order by v)),
ranked as (select *, {gain} as gain, row_number() over (partition by c order by {gain} desc, f, v) as place from cut where hl >= 2 and h - hl >= 2)
select {'0' if classes == 1 else 'c'}::int as class, case f when 0 then 'c_nationkey' else 'c_custkey % 7' end as feature, v as cut, round(gain, 3) as gain,
       {leaf.format('gl', 'hl')} as left_value, {leaf.format('(g - gl)', '(h - hl)')} as right_value
from ranked where place = 1 and gain >= 0.1"""


def _first_round(spark, sf, label, n_classes: int):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", label.cast("int").alias("label"))
    ready = VectorAssembler(inputCols=ROUND_FEATURES, outputCol="features").transform(customers.withColumn("c_custkey % 7", F.col("c_custkey") % 7))
    nodes = boosting.fit(ready, n_classes, ONE_ROUND, key="c_custkey")[0].table(spark)
    at = lambda node, value: F.max(F.when(F.col("node") == node, F.col(value)))
    split = nodes.groupBy("class").agg(at(0, "feature").alias("f"), at(0, "cut").alias("cut"), F.round(at(0, "gain"), 3).alias("gain"), F.round(at(1, "value"), 6).alias("left_value"), F.round(at(2, "value"), 6).alias("right_value"))
    names = F.array(*[F.lit(f) for f in ROUND_FEATURES])
    return split.where("f >= 0").select("class", F.get(names, F.col("f")).alias("feature"), "cut", "gain", "left_value", "right_value")


MIXED = "(c_nationkey * 7 + (c_custkey % 7) * 3) % 10"


@query("boosted_first_split", round_sql(f"case when {MIXED} >= 5 or c_nationkey >= 18 then 1 else 0 end", 1, "0.5", "0.25"))
def boosted_first_split(spark, sf):
    """Split, gain and leaf values of the first tree of a 0/1 label."""
    return _first_round(spark, sf, F.expr(f"case when {MIXED} >= 5 or c_nationkey >= 18 then 1 else 0 end"), 2)


@query("boosted_first_round_of_a_softmax", round_sql("(c_nationkey // 9)::int", 3, "(1.0::double / 3)", "(4.0::double / 9)"))
def boosted_first_round_of_a_softmax(spark, sf):
    """The same for every class of a softmax, grown together."""
    return _first_round(spark, sf, F.floor(F.col("c_nationkey") / 9), 3)


IMPORTANCE_SQL = """select * from (values ('c_nationkey', 1.0::double), ('c_acctbal', 0.0::double), ('c_custkey % 7', 0.0::double)) t(feature, importance)"""


@query("feature_importance", IMPORTANCE_SQL)
def feature_importance(spark, sf):
    """All gain is on the one feature that splits the classes."""
    return rounded(models.feature_importance(spark, binary_model(spark, sf), CUSTOMER_FEATURES), ["importance"])


@query("mean_importance", IMPORTANCE_SQL)
def mean_importance(spark, sf):
    fitted = boosted_folds(spark, sf).models
    return rounded(models.mean_importance([models.feature_importance(spark, m, CUSTOMER_FEATURES) for m in fitted]), ["importance"])


@query("feature_importance_share", "select 3::bigint as n_features, 1.0::double as total, 'c_nationkey' as best")
def feature_importance_share(spark, sf):
    shares = models.feature_importance(spark, binary_model(spark, sf), CUSTOMER_FEATURES).agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("total"), F.max_by("feature", "importance").alias("best")
    )
    return rounded(shares, ["total"])


# --- class head and embedding --------------------------------------------------


@once
def indicator_rows(spark, sf):
    """Customers with one indicator per class, apart by ten, beside small noise: linearly separable."""
    label = F.floor(F.col("c_nationkey") / 9).cast("int")
    indicators = [F.when(label == c, 10.0).otherwise(0.0) for c in range(3)]
    noise = [F.sin(F.col("c_custkey") * (i + 1)) for i in range(5)]
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), label.alias("label"), array_to_vector(F.array(*indicators, *noise)).alias("features")
    )
    return stage(folds.stratified_folds(rows, "label", "row_id", k=folds.BINARY_FOLDS), "indicators", partition_by="fold")


@query("fit_class_head", separable_sql(TYPE_LABEL))
def fit_class_head(spark, sf):
    rows = indicator_rows(spark, sf)
    scored = models.fit_class_head(rows, 8, 3).transform(rows)
    return scored.select("row_id", "label", F.col("prediction").cast("int").alias("prediction"))


@once
def latent_folds(spark, sf):
    rows = indicator_rows(spark, sf)
    return models.cross_validate(rows, lambda t: models.fit_latent(t, 8, 3), models.score_latent, folds.BINARY_FOLDS, FITS_AT_ONCE, fit_tasks(rows))


@query("cross_validate_latent", separable_sql(TYPE_LABEL, folds.BINARY_FOLDS))
def cross_validate_latent(spark, sf):
    return latent_folds(spark, sf).oof.select("row_id", "label", "prediction", "fold")


@query("loss_curve", "select i::int as fold, 0.0::double as last_loss from range(0, 10) r(i)")
def loss_curve(spark, sf):
    """On a separable table the loss of every fold's head ends at zero."""
    losses = models.loss_curve(spark, [m.stages[1] for m in latent_folds(spark, sf).models])
    return losses.groupBy("fold").agg(F.round(F.max_by("loss", "iteration"), 2).alias("last_loss"))


@query("loss_curve_improves", "select i::int as fold, 0::bigint as n_above_first from range(0, 10) r(i)")
def loss_curve_improves(spark, sf):
    """No later loss of a fold's head is above its first."""
    losses = models.loss_curve(spark, [m.stages[1] for m in latent_folds(spark, sf).models])
    first = losses.groupBy("fold").agg(F.min_by("loss", "iteration").alias("first"))
    return losses.join(first, "fold").groupBy("fold").agg(F.count_if(F.col("loss") > F.col("first")).alias("n_above_first"))


JOINT_EPOCHS = 50


@once
def joint_models(spark, sf):
    """The joint models of all folds and, last, of all rows."""
    rows = indicator_rows(spark, sf)
    settings = joint.Joint(8, 3, epochs=JOINT_EPOCHS)
    return joint.fit(rows.coalesce(fit_tasks(rows)), settings, [*range(folds.BINARY_FOLDS), None], key="row_id")


@query("fit_joint_latent", separable_sql(TYPE_LABEL))
def fit_joint_latent(spark, sf):
    return joint.score(joint_models(spark, sf)[-1], indicator_rows(spark, sf)).select("row_id", "label", "prediction")


@query("cross_validate_joint", separable_sql(TYPE_LABEL, folds.BINARY_FOLDS))
def cross_validate_joint(spark, sf):
    scored = models.score_folds(indicator_rows(spark, sf), joint_models(spark, sf)[:-1], joint.score)
    return scored.oof.select("row_id", "label", "prediction", "fold")


@query(
    "joint_loss_curves",
    f"""with split as ({separable_sql(TYPE_LABEL, folds.BINARY_FOLDS)}),
        sizes as (select fold, (select count(*) from split) - count(*) as n_learned from split group by fold)
        select fold, {JOINT_EPOCHS}::bigint as n_epochs, n_learned, 0::bigint as n_off, true as fell from sizes""",
)
def joint_loss_curves(spark, sf):
    """Every epoch of a fold counts the rows it learned from once, the parts add up to the loss, and the loss falls."""
    curves_of_folds = joint.loss_curves(spark, joint_models(spark, sf)[:-1])
    parts = F.col("recon") + latent.BETA * F.col("kl") + latent.LAMBDA_CLASS * F.col("cls")
    return curves_of_folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.min("n").alias("n_learned"),
        F.count_if(F.abs(F.col("loss") - parts) > 1e-6).alias("n_off"),
        (F.max_by("loss", "epoch") < F.min_by("loss", "epoch")).alias("fell"),
    )


# Of two numbers per vector (sums of its halves) the principal axes have a closed form.
PLANE_SQL = """
halves as (select vec_id as row_id, label, list_sum(list_transform(embedding[1:32], lambda v: v::double)) as a,
                  list_sum(list_transform(embedding[33:64], lambda v: v::double)) as b from embeddings),
cov as (select var_samp(a) as aa, var_samp(b) as bb, covar_samp(a, b) as ab from halves),
top as (select *, (aa + bb) / 2 + sqrt(pow((aa - bb) / 2, 2) + ab * ab) as l from cov),
axis as (select ab / sqrt(ab * ab + pow(l - aa, 2)) as u, (l - aa) / sqrt(ab * ab + pow(l - aa, 2)) as v from top),
signed as (select sign(u) * u as u, sign(u) * v as v from axis)
"""


def _halves(spark, sf):
    half = "aggregate(slice(embedding, {first}, 32), 0.0D, (total, v) -> total + cast(v as double))"
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label", F.expr(half.format(first=1)).alias("a"), F.expr(half.format(first=33)).alias("b")
    )


def _upright(df, x, y):
    """Turn both axes so that they rise with the first number: the sign of an axis is arbitrary."""
    signs = df.agg(F.signum(F.covar_samp(x, "a")), F.signum(F.covar_samp(y, "a"))).first()
    return df.withColumns({x: F.col(x) * signs[0], y: F.col(y) * signs[1]})


@query(
    "latent_embed",
    f"with {PLANE_SQL} select row_id, round(a * u + b * v, 6) as z1, round(sign(v) * (a * v - b * u), 6) as z2 from halves, signed",
)
def latent_embed(spark, sf):
    rows = _halves(spark, sf).withColumn("features", array_to_vector(F.array("a", "b")))
    z = vector_to_array(F.col("embedding"))
    embedded = models.fit_embedding(rows, k=2).transform(rows).select("row_id", "a", z[0].alias("z1"), z[1].alias("z2"))
    return rounded(_upright(embedded, "z1", "z2").select("row_id", "z1", "z2"), ["z1", "z2"])


@query(
    "project_2d",
    f"with {PLANE_SQL} select row_id, label, round(a * u + b * v, 6) as x, round(sign(v) * (a * v - b * u), 6) as y from halves, signed",
)
def project_2d(spark, sf):
    rows = _halves(spark, sf).withColumn("z", F.array("a", "b"))
    return rounded(_upright(models.project_2d(rows), "x", "y").select("row_id", "label", "x", "y"), ["x", "y"])


@query(
    "project_2d_axes",
    f"with {PLANE_SQL} select (select count(*) from halves) as n, 0.0::double as correlation, round(l, 6) as first, round(aa + bb - l, 6) as second from top",
)
def project_2d_axes(spark, sf):
    """The two axes of the map are uncorrelated and carry the two eigenvalues of the covariance."""
    plane = models.project_2d(_halves(spark, sf).withColumn("z", F.array("a", "b")))
    found = plane.agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.corr("x", "y")).alias("correlation"), F.var_samp("x").alias("first"), F.var_samp("y").alias("second")
    )
    return rounded(found, ["correlation", "first", "second"])


@query("neighbour_map", "select vec_id as row_id, label, true as placed, true as spread from embeddings")
def neighbour_map(spark, sf):
    """Every vector has a place and the map is not one point; how well it keeps neighbours is tested on planted groups."""
    mapped = stage(neighbours.neighbour_map(table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("z"))), "map")
    wide = mapped.agg((F.least(F.stddev_samp("x"), F.stddev_samp("y")) > 0.1).alias("spread"))
    placed = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    return mapped.select("row_id", "label", placed.alias("placed")).withColumn("spread", wide.scalar())


@query(
    "reconstruct",
    """select vec_id as row_id, round(list_sum(list_transform(embedding, lambda v: v::double * v::double)), 6) as energy
       from embeddings""",
)
def reconstruct(spark, sf):
    """Reconstructed energy plus the error is the energy of the sample (components are orthonormal)."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features")
    )
    model = models.fit_embedding(rows)
    x = vector_to_array(F.col("features")).alias("x")
    z = vector_to_array(F.col("embedding")).alias("z")
    rebuilt = model.transform(rows).select("row_id", x, z).withColumn("x_recon", latent.reconstruct(model, F.col("z")))
    kept = vectors.total(F.transform("x_recon", lambda v: v * v))
    scored = latent.recon_error(rebuilt)
    return scored.select("row_id", F.round(kept + F.col("recon_error"), 6).alias("energy"))


# --- values outside the fitted range -------------------------------------------

RANGE_SQL = """
with raw as (
  select c_custkey as row_id, c_custkey % 10 = 0 as held,
         case when c_custkey % 40 = 0 then -99999.0::double when c_custkey % 40 = 10 then null when c_custkey % 40 = 20 then 0.0::double else c_acctbal end as v
  from customer),
fitted as (select min(v) as low, median(v) as mid from raw where not held),
off as (select *, case when low > 0 then 0 else abs(low) + 1 end as o from fitted),
logged as (select row_id, held, v, low, log2(greatest(coalesce(v, mid), low) + o) as y from raw, off),
stats as (select avg(y) as m, stddev_pop(y) as s from logged where not held)
select row_id, round((y - m) / s, 6) as scaled, coalesce(v < low, false)::int as n_clamped from logged, stats where held
"""


@query("preprocess_outside_the_range", RANGE_SQL)
def preprocess_outside_the_range(spark, sf):
    """Rows that were not fitted: a value below the range counts as its lowest, a missing one as the median."""
    key = F.col("c_custkey")
    text = F.when(key % 40 == 0, "-99999").when(key % 40 == 10, "n/a").when(key % 40 == 20, "*0").otherwise(F.col("c_acctbal").cast("string"))
    raw = table(spark, sf, "customer").select(key.alias("row_id"), text.alias("v"))
    cleaned = clean.clean_numeric(raw, ["v"])
    prep = fit_preprocessing(cleaned.where("row_id % 10 <> 0"), ["v"])
    held = prep.count_clamped(cleaned.where("row_id % 10 = 0"))
    return rounded(prep.transform_filled(held).select("row_id", F.col("v").alias("scaled"), "n_clamped"), ["scaled"])


SINGLE_CLASS_SQL = """
with groups as (
  select case when c_nationkey < 5 then c_mktsegment else 'mixed' end as grp, c_acctbal as score, case when c_mktsegment = 'BUILDING' then 0 else 1 end as label
  from customer),
g as (select grp, score, sum(label) as tp, sum(1 - label) as fp from groups group by 1, 2),
c as (select grp, score, sum(tp) over w as tps, sum(fp) over w as fps, sum(tp) over (partition by grp) as p, sum(fp) over (partition by grp) as q
      from g window w as (partition by grp order by score desc)),
pts as (select grp, score as thr, fps::double / nullif(q, 0) as fpr, tps::double / nullif(p, 0) as tpr, p, q from c
        union all select grp, 'inf'::double, 0.0, 0.0, max(p), max(q) from c group by grp)
select grp, case when max(p) > 0 and max(q) > 0 then min(thr) filter (where 1 - fpr >= 0.99) else 0.5::double end as threshold,
       case when max(p) > 0 and max(q) > 0 then round(arg_min(tpr, thr) filter (where 1 - fpr >= 0.99), 6) end as sensitivity,
       case when max(p) > 0 and max(q) > 0 then round(arg_min(1 - fpr, thr) filter (where 1 - fpr >= 0.99), 6) end as specificity
from pts group by grp
"""


@query("threshold_single_class_groups", SINGLE_CLASS_SQL)
def threshold_single_class_groups(spark, sf):
    """A group with a single class has no specificity: it takes the plain prediction's threshold."""
    segment = F.when(F.col("c_nationkey") < 5, F.col("c_mktsegment")).otherwise("mixed")
    scored = table(spark, sf, "customer").select(
        segment.alias("grp"), F.col("c_acctbal").alias("score"), (F.col("c_mktsegment") != "BUILDING").cast("int").alias("label")
    )
    points = curves.threshold_at_specificity(curves.roc_curve(scored, by=["grp"]), ["grp"])
    return rounded(points, ["sensitivity", "specificity"])


# --- bundles and scoring ----------------------------------------------------

COHORT_SQL = """
samples as (
  select vec_id as row_id, label as code,
         case when label < 4 then 'Normal' when label < 6 then 'Lung' when label < 8 then 'Ovary' else 'Breast' end as "Condition",
         case when label >= 4 then ['I', 'II', 'III'][vec_id % 3 + 1] end as "Stage"
  from embeddings)
"""


def _bundle(spark, sf, kind: str) -> tuple[ModelBundle, object]:
    samples = assay_cohort(spark, sf)
    if kind != "binary":
        samples = clean.exclude_class(samples)
    features = clean.feature_columns(samples.columns, use_age=kind != "binary")
    cleaned = stage(clean.clean_numeric(samples, features), "bundle-rows")
    prep = fit_preprocessing(cleaned, features)
    scaled = prep.transform(clean.drop_missing(cleaned, features))
    if kind == "binary":
        rows = stage(clean.assemble(clean.binary_label(scaled, out="label"), features).select("label", "features").coalesce(fit_tasks(cleaned)), "bundle-fit")
        return ModelBundle(kind, models.fit_boosted_binary(rows), prep, ["Normal", "Cancer"]), samples
    codes = clean.fit_label_codes(scaled, "Condition")
    rows = stage(clean.assemble(clean.encode_labels(scaled, codes), features).select("label", "features").coalesce(fit_tasks(cleaned)), "bundle-fit")
    classes = list(codes.labels)
    if kind == "type":
        return ModelBundle(kind, models.fit_boosted_multi(rows), prep, classes), samples
    return ModelBundle(kind, models.fit_latent(rows, len(features), len(classes)), prep, classes), samples


binary_bundle = once(lambda spark, sf: _bundle(spark, sf, "binary"))
type_bundle = once(lambda spark, sf: _bundle(spark, sf, "type"))
latent_bundle = once(lambda spark, sf: _bundle(spark, sf, "latent"))


def _with_gaps(samples):
    """Some values unreadable, and some below anything fitted."""
    odd = F.when(F.col("row_id") % 5 == 0, "n/a").when(F.col("row_id") % 5 == 1, "-7").otherwise(F.col("AFP (pg/ml)"))
    return samples.withColumn("AFP (pg/ml)", odd)


RISK_SQL = f"""with {COHORT_SQL} select row_id, (code >= 4)::int as prediction, case when code >= 4 then 'Cancer' else 'Normal' end as predicted_class,
                      (code >= 4)::int as above_half, (row_id % 5 = 1)::int as n_clamped from samples"""


def _risk(scored):
    return scored.select("row_id", "prediction", "predicted_class", (F.col("cancer_probability") > 0.5).cast("int").alias("above_half"), "n_clamped")


@query("score_risk", RISK_SQL)
def score_risk(spark, sf):
    bundle, samples = binary_bundle(spark, sf)
    return _risk(scoring.score_risk(_with_gaps(samples), bundle))


@query("score_risk_batch_median", RISK_SQL)
def score_risk_batch_median(spark, sf):
    bundle, samples = binary_bundle(spark, sf)
    return _risk(scoring.score_risk(_with_gaps(samples), bundle, missing="batch"))


@query(
    "save_and_load_bundle",
    f"with {COHORT_SQL} select row_id, case when code >= 4 then 'Cancer' else 'Normal' end as predicted_class, 0.0::double as difference from samples",
)
def save_and_load_bundle(spark, sf):
    """Scores before saving and after loading agree on every row."""
    bundle, samples = binary_bundle(spark, sf)
    path = scratch_path(spark, "bundle")
    save_bundle(bundle, path, spark)
    before = scoring.score_risk(samples, bundle).select("row_id", F.col("cancer_probability").alias("before"))
    after = scoring.score_risk(samples, load_bundle(path, spark)).select("row_id", "predicted_class", "cancer_probability")
    return before.join(after, "row_id").select("row_id", "predicted_class", F.abs(F.col("before") - F.col("cancer_probability")).alias("difference"))


TYPES_SQL = f"""with {COHORT_SQL} select row_id, "Condition" as best, 2 as n_labels, 2 as n_probabilities from samples where code >= 4"""


def _best_type(scored, *more):
    first = F.get("top_labels", F.lit(0)).alias("best")
    return scored.select("row_id", first, F.size("top_labels").alias("n_labels"), F.size("top_probabilities").alias("n_probabilities"), *more)


@query("score_types", TYPES_SQL)
def score_types(spark, sf):
    bundle, samples = type_bundle(spark, sf)
    return _best_type(scoring.score_types(_with_gaps(samples), bundle))


@query("score_types_cell_median", TYPES_SQL)
def score_types_cell_median(spark, sf):
    bundle, samples = type_bundle(spark, sf)
    return _best_type(scoring.score_types(_with_gaps(samples), bundle, missing="cells"))


@query("score_types_with_embedding", TYPES_SQL.replace("n_probabilities", "n_probabilities, 8 as dimensions"))
def score_types_with_embedding(spark, sf):
    """Rows the head was trained on: it has learned every one of them."""
    bundle, samples = latent_bundle(spark, sf)
    scored = scoring.score_types(samples, bundle, with_embedding=True)
    return _best_type(scored, F.size("embedding").alias("dimensions"))


# --- whole studies ----------------------------------------------------------

binary_study = once(lambda spark, sf: run_binary(assay_cohort(spark, sf), parallelism=FITS_AT_ONCE))
type_study = once(lambda spark, sf: run_type(assay_cohort(spark, sf), parallelism=FITS_AT_ONCE))
weighted_study = once(lambda spark, sf: run_type(assay_cohort(spark, sf), weighted=True, parallelism=FITS_AT_ONCE))
latent_binary_study = once(lambda spark, sf: run_latent(assay_cohort(spark, sf), "binary", parallelism=FITS_AT_ONCE))
latent_type_study = once(lambda spark, sf: run_latent(assay_cohort(spark, sf), "type", parallelism=FITS_AT_ONCE))

N_SCORES = N_SUMS + 2


def dataset_sql(rows: str, columns: int, features: int, classes: int, **settings: int) -> str:
    """The facts of a cohort as summary rows."""
    facts = {"original columns": columns, "features": features, "classes": classes, **settings}
    listed = ", ".join(f"('dataset', '{k}', {v}::double)" for k, v in facts.items())
    return f"""select 'dataset' as section, key, count(*)::double as value from samples, (select unnest(['original rows', 'final rows']) as key) {rows} group by key
               union all select * from (values {listed}) t(section, key, value)"""


# Every number of a study whose marker gives the class away: all rates are one.
PERFECT_REPORT = """
select 'report', {name} || ' ' || m, case when m = 'support' then n::double else 1.0 end
from {source}, (select unnest(['precision', 'recall', 'f1', 'support']) as m)
"""
BINARY_SUMMARY_SQL = f"""
with {COHORT_SQL},
classes as (select (code >= 4)::int::varchar as c, count(*) as n from samples group by 1
            union all select unnest(['accuracy', 'macro avg', 'weighted avg']), (select count(*) from samples))
{dataset_sql('', 5 + len(ASSAY_COLUMNS) + N_SCORES, len(ASSAY_COLUMNS) + N_SCORES, 2, folds=10, rounds=100)}
union all select 'fold accuracy', i::varchar, 1.0 from range(0, 10) r(i)
union all select * from (values ('accuracy', 'all mean', 1.0), ('accuracy', 'all std', 0.0), ('auc', 'all', 1.0), ('auc by fold', 'all mean', 1.0), ('auc by fold', 'all std', 0.0))
union all select 'sensitivity by class', "Condition" || ' ' || m, case when m = 'error' then 0.0 else 1.0 end
          from (select distinct "Condition" from samples where code >= 4), (select unnest(['sensitivity', 'error']) as m)
union all select 'sensitivity by stage', "Stage" || ' ' || m, case when m = 'error' then 0.0 else 1.0 end
          from (select distinct "Stage" from samples where code >= 4), (select unnest(['sensitivity', 'error']) as m)
union all select 'confusion', 'all true_negative', count(*) from samples where code < 4
union all select 'confusion', 'all true_positive', count(*) from samples where code >= 4
union all select * from (values ('confusion', 'all false_positive', 0.0), ('confusion', 'all false_negative', 0.0))
union all {PERFECT_REPORT.format(name='c', source='classes')}
"""


@query("run_binary_summary", BINARY_SUMMARY_SQL)
def run_binary_summary(spark, sf):
    return rounded(binary_study(spark, sf).tables["summary"], ["value"])


TYPE_SUMMARY_SQL = f"""
with {COHORT_SQL},
cancers as (select * from samples where code >= 4),
per as (select "Condition" as c, count(*) as n from cancers group by 1),
classes as (select * from per union all select unnest(['accuracy', 'macro avg', 'weighted avg']), (select count(*) from cancers))
{dataset_sql('where code >= 4', 5 + len(ASSAY_COLUMNS) + N_SCORES, len(ASSAY_COLUMNS) + N_SCORES + 1, 3, folds=5, rounds=100)}
union all select 'class distribution', c || ' ' || m, case when m = 'n' then n else round(100.0::double * n / (select count(*) from cancers), 6) end
          from per, (select unnest(['n', 'pct']) as m)
union all select 'fold accuracy', i::varchar, 1.0 from range(0, 5) r(i)
union all select * from (values ('accuracy', 'all mean', 1.0), ('accuracy', 'all std', 0.0))
union all select 'accuracy by class', c || ' ' || m, case when m in ('top1', 'top2') then 1.0 else n end
          from per, (select unnest(['total', 'top1', 'top1_correct', 'top2', 'top2_correct']) as m)
union all {PERFECT_REPORT.format(name='c', source='classes')}
"""


@query("run_type_summary", TYPE_SUMMARY_SQL)
def run_type_summary(spark, sf):
    return rounded(type_study(spark, sf).tables["summary"], ["value"])


@query("run_type_weighted_summary", TYPE_SUMMARY_SQL)
def run_type_weighted_summary(spark, sf):
    return rounded(weighted_study(spark, sf).tables["summary"], ["value"])


STUDY_SQL = f"""
with {COHORT_SQL}, coded as (select *, {{code}} as label from samples {{where}})
select row_id, "Condition", label::int as label, label::int as prediction,
       ((row_number() over (order by label, md5(concat('42|', cast(row_id as varchar))), row_id) - 1) % {{k}})::int as fold
from coded
"""


@query("run_binary_oof", STUDY_SQL.format(where="", code="(code >= 4)::int", k=folds.BINARY_FOLDS))
def run_binary_oof(spark, sf):
    """Every sample of the study is scored once, in its own fold, and called what it is."""
    return binary_study(spark, sf).tables["oof"].select("row_id", "Condition", "label", "prediction", "fold")


@query("run_type_weighted_oof", STUDY_SQL.format(where="where code >= 4", code="""dense_rank() over (order by "Condition") - 1""", k=folds.TYPE_TREE_FOLDS))
def run_type_weighted_oof(spark, sf):
    """As above for the type study: normal samples are out, labels are sorted codes."""
    return weighted_study(spark, sf).tables["oof"].select("row_id", "Condition", "label", "prediction", "fold")


LATENT_SUMMARY_SQL = f"""
with {COHORT_SQL},
classes as (select (code >= 4)::int::varchar as c, count(*) as n from samples group by 1
            union all select unnest(['accuracy', 'macro avg', 'weighted avg']), (select count(*) from samples))
select section, key, value from (
  {dataset_sql('', 5 + len(ASSAY_COLUMNS) + N_SCORES, len(ASSAY_COLUMNS) + N_SCORES, 2, folds=10)}
  union all select * from (values ('dataset', 'latent dimension', 8.0), ('dataset', 'beta', 5.0), ('dataset', 'lambda', 20.0)))
union all select 'fold accuracy', i::varchar, null from range(0, 10) r(i)
union all select * from (values ('accuracy', 'all mean', null::double), ('accuracy', 'all std', null), ('auc', 'all', null), ('auc by fold', 'all mean', null), ('auc by fold', 'all std', null))
union all select 'sensitivity by class', "Condition" || ' ' || m, null
          from (select distinct "Condition" from samples where code >= 4), (select unnest(['sensitivity', 'error']) as m)
union all select 'sensitivity by stage', "Stage" || ' ' || m, null
          from (select distinct "Stage" from samples where code >= 4), (select unnest(['sensitivity', 'error']) as m)
union all select 'confusion', 'all', count(*) from samples
union all select 'report', c || ' ' || m, case when m = 'support' then n::double end from classes, (select unnest(['precision', 'recall', 'f1', 'support']) as m)
"""


@query("run_latent_binary_summary", LATENT_SUMMARY_SQL)
def run_latent_binary_summary(spark, sf):
    """All entries of the summary; values where they follow from the cohort (confusion cells as their sum)."""
    summary = latent_binary_study(spark, sf).tables["summary"]
    confusion = F.col("section") == "confusion"
    keyed = summary.withColumn("key", F.when(confusion, "all").otherwise(F.col("key")))
    follows = (F.col("section") == "dataset") | confusion | F.col("key").endswith(" support")
    known = keyed.withColumn("value", F.when(follows, F.col("value")))
    return known.groupBy("section", "key").agg(F.sum("value").alias("value"))


@query(
    "run_latent_type_attributions",
    f"""with {COHORT_SQL}, cancers as (select * from samples where code >= 4),
        explained as (select row_id from cancers order by md5(concat('{EXPLAINED_SEED}|', cast(row_id as varchar))), row_id limit {explain.EXPLAINED_ROWS})
        select row_id, c::int as class, {len(ASSAY_COLUMNS) + N_SCORES + 1}::bigint as n_features, 0.0::double as difference from explained, range(0, 3) r(c)""",
)
def run_latent_type_attributions(spark, sf):
    """Base and attributions of every explained row and class add up to the score of the model."""
    study = latent_type_study(spark, sf)
    best = study.tables["best_fold"].first()["fold"]
    head, features = study.fold_models[best].stages[1], study.bundle.preprocessing.features
    summed = study.tables["attributions"].groupBy("row_id", "class").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("phi").alias("phi"), F.first("base").alias("base")
    )
    probs = vector_to_array(F.col("probability"))
    scored = head.transform(clean.assemble(study.tables["preprocessed"], features)).select("row_id", F.posexplode(probs).alias("class", "p"))
    joined = summed.join(scored, ["row_id", "class"])
    return joined.select("row_id", "class", "n_features", F.round(F.abs(F.col("base") + F.col("phi") - F.col("p")), 6).alias("difference"))


# --- what a study leaves on disk ---------------------------------------------


def _read_back(spark, study, name):
    """Classes of the preprocessed rows, the confusion matrix and the best feature, from the files."""
    parts = write_study(study, scratch_path(spark, name))
    text = lambda path, **options: spark.read.options(header=True, **options).csv(path)
    rows = text(parts["preprocessed"]).groupBy(F.col("Condition").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    found = rows.select(F.lit("preprocessed").alias("part"), "key", "value")
    matrix = text(parts["confusion_matrix"])
    cells = [F.struct(F.concat_ws(" as ", "class", F.lit(c)).alias("key"), F.col(f"`{c}`").cast("double").alias("value")) for c in study.bundle.classes]
    found = found.union(matrix.select(F.lit("confusion").alias("part"), F.inline(F.array(*cells))))
    settings = text(parts["summary"]).where("section = 'dataset'").select(F.lit("summary").alias("part"), "key", F.col("value").cast("double"))
    found = found.union(settings)
    loaded = load_bundle(parts["bundle"], spark)
    found = found.union(spark.createDataFrame([("bundle", loaded.kind, float(len(loaded.preprocessing.features)))], "part string, key string, value double"))
    return parts, found


@query(
    "write_study_binary",
    f"""with {COHORT_SQL}, facts as ({dataset_sql('', 5 + len(ASSAY_COLUMNS) + N_SCORES, len(ASSAY_COLUMNS) + N_SCORES, 2, folds=10, rounds=100)})
        select 'preprocessed' as part, "Condition" as key, count(*)::double as value from samples group by 2
        union all select 'binary_condition', (code >= 4)::int::varchar, count(*) from samples group by 2
        union all select 'confusion', t || ' as ' || p, case when t = p then (select count(*) from samples where (code >= 4) = (t = 'Cancer')) else 0 end
                  from (select unnest(['Normal', 'Cancer']) as t), (select unnest(['Normal', 'Cancer']) as p)
        union all select 'summary', key, value from facts
        union all select 'bundle', 'binary', {len(ASSAY_COLUMNS) + N_SCORES}
        union all select 'best feature', '{MARKER}', {len(ASSAY_COLUMNS) + N_SCORES}""",
)
def write_study_binary(spark, sf):
    parts, found = _read_back(spark, binary_study(spark, sf), "binary-study")
    rows = spark.read.option("header", True).csv(parts["preprocessed"])
    labels = rows.groupBy(F.col("binary_condition").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    ranked = spark.read.schema("Feature string, Importance double").option("header", True).csv(parts["feature_importance"])
    # Either of the two equal markers.
    first = F.max_by(F.when(F.col("Feature").endswith("marker"), MARKER).otherwise(F.col("Feature")), "Importance")
    best = ranked.agg(first.alias("key"), F.count(F.lit(1)).cast("double").alias("value"))
    return found.union(labels.select(F.lit("binary_condition").alias("part"), "key", "value")).union(best.select(F.lit("best feature").alias("part"), "key", "value"))


@query(
    "write_study_type",
    f"""with {COHORT_SQL}, facts as ({dataset_sql('where code >= 4', 5 + len(ASSAY_COLUMNS) + N_SCORES, len(ASSAY_COLUMNS) + N_SCORES + 1, 3, folds=5, rounds=100)}),
        per as (select "Condition" as c, count(*)::double as n from samples where code >= 4 group by 1)
        select 'preprocessed' as part, c as key, n as value from per
        union all select 'confusion', t.c || ' as ' || p.c, case when t.c = p.c then t.n else 0 end from per t, per p
        union all select 'summary', key, value from facts
        union all select 'bundle', 'type', {len(ASSAY_COLUMNS) + N_SCORES + 1}
        union all select 'patients', 'distinct', sum(n) from per
        union all select 'class weights', c, round((select sum(n) / 3 from per) / n, 6) from per""",
)
def write_study_type(spark, sf):
    study = weighted_study(spark, sf)
    parts, found = _read_back(spark, study, "type-study")
    patients = spark.read.option("header", True).csv(parts["preprocessed"]).agg(F.count_distinct("PatientID").cast("double").alias("value"))
    weights = spark.read.schema("label int, weight double").option("header", True).csv(parts["class_weights"])
    names = F.array(*[F.lit(c) for c in study.bundle.classes])
    weighted = weights.select(F.lit("class weights").alias("part"), F.get(names, F.col("label")).alias("key"), F.round("weight", 6).alias("value"))
    return found.union(patients.select(F.lit("patients").alias("part"), F.lit("distinct").alias("key"), "value")).union(weighted)


@query(
    "write_study_latent",
    f"""with {COHORT_SQL}, facts as ({dataset_sql('', 5 + len(ASSAY_COLUMNS) + N_SCORES, len(ASSAY_COLUMNS) + N_SCORES, 2, folds=10)})
        select 'preprocessed' as part, "Condition" as key, count(*)::double as value from samples group by 2
        union all select 'confusion', case when code >= 4 then 'Cancer' else 'Normal' end, count(*) from samples group by 2
        union all select 'summary', key, value from facts
        union all select * from (values ('summary', 'latent dimension', 8.0), ('summary', 'beta', 5.0), ('summary', 'lambda', 20.0))
        union all select 'bundle', 'latent', {len(ASSAY_COLUMNS) + N_SCORES}
        union all select 'top features', '1 to 20', 20.0""",
)
def write_study_latent(spark, sf):
    parts, found = _read_back(spark, latent_binary_study(spark, sf), "latent-study")
    confusion = F.col("part") == "confusion"
    cells = found.withColumn("key", F.when(confusion, F.split("key", " as ")[0]).otherwise(F.col("key")))
    summed = cells.groupBy("part", "key").agg(F.sum("value").alias("value"))
    top = spark.read.schema("Rank int, Feature string, i double").options(header=True, sep="\t").csv(parts["top_features"])
    listed = top.agg(F.concat_ws(" to ", F.min("Rank"), F.max("Rank")).alias("key"), F.count_distinct("Feature").cast("double").alias("value"))
    return summed.union(listed.select(F.lit("top features").alias("part"), "key", "value"))


FOLD_SCALE_SQL = f"""
with {COHORT_SQL}
select row_id, (code >= 4)::int as label, (code >= 4)::int as prediction,
       ((row_number() over (order by (code >= 4)::int, md5(concat('42|', cast(row_id as varchar))), row_id) - 1) % 5)::int as fold
from samples
"""


@query("validate_with_scales_of_the_folds", FOLD_SCALE_SQL)
def validate_with_scales_of_the_folds(spark, sf):
    """Offsets and scales fitted on training folds only: extreme held-out values lose no row."""
    odd = F.when(F.col("row_id") % 97 == 0, "0").when(F.col("row_id") % 97 == 1, "-5").when(F.col("row_id") == 3, "-100000")
    samples = assay_cohort(spark, sf).withColumn("AFP (pg/ml)", F.coalesce(odd, F.col("AFP (pg/ml)")))
    cohort = prepare_cohort(samples, "binary", 5, fit_scope="train", with_medians=False)
    cv = validate(cohort, models.fit_boosted_binary, models.score_binary, ["row_id"], FITS_AT_ONCE)
    return cv.oof.select("row_id", "label", "prediction", "fold")


@query(
    "profile_cohort",
    """with t as (select case when label < 4 then 'Normal' when label < 6 then 'Lung' when label < 8 then 'Ovary' else 'Breast' end as "Condition",
                         case when label >= 4 then ['I', 'II', 'III'][vec_id % 3 + 1] end as "Stage" from embeddings),
       c as (select "Stage", "Condition", count(*) as n from t where "Stage" is not null group by 1, 2)
       select "Stage", "Condition", n, round(100.0::double * n / sum(n) over (partition by "Condition"), 6) as pct from c""",
)
def profile_cohort_stage_share(spark, sf):
    return rounded(profile_cohort(assay_cohort(spark, sf))["stage_share_by_label"], ["pct"])
