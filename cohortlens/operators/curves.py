"""ROC curve, area and operating points from scores, without a single-task sort.

The running counts behind a ROC curve need all distinct scores in order. Here the score
axis is cut at approximate quantiles into ranges of similar row count; counts are summed
per range, range starts come from a running sum over those few ranges, and the order
inside a range is one window task per range. Equal scores are merged before anything is
sorted, so a score shared by a third of all rows is one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.numbers import col, present, ratio
from cohortlens.operators.lookup import lookup_join

# Operating point and the width of the band shown around an area.
SPECIFICITY = 0.99
AUC_BAND = 0.01
# Fixed value: threshold of a group with a single class, where no specificity is defined.
FALLBACK_THRESHOLD = 0.5

# Rows of a range of the score axis, on average.
RANGE_ROWS = 1_000_000


def score_edges(df: DataFrame, score: str = "score", ranges: int | None = None) -> list[float]:
    """Cut points of the score axis; their number follows the number of rows.

    One narrow scan of the score column gives the count and as many quantiles as small tables need; a
    table whose rows ask for more ranges takes a second one.
    """
    scores = df.select(present(score).alias("score"))

    def quantiles(n: int) -> Column:
        return F.percentile_approx("score", [i / n for i in range(1, n)], 4 * n)

    if ranges is None:
        ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows, cuts = scores.agg(F.count("score"), quantiles(ranges)).first()
        if rows > ranges * RANGE_ROWS:
            ranges = math.ceil(rows / RANGE_ROWS)
            cuts = scores.agg(quantiles(ranges)).first()[0]
    else:
        cuts = scores.agg(quantiles(ranges)).first()[0] if ranges > 1 else []
    return sorted({c for c in cuts or [] if math.isfinite(c)})


def _with_range(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    if not edges:
        return df.withColumn("_range", F.lit(0))
    splits = [-math.inf, *edges, math.inf]
    cut = Bucketizer(splits=splits, inputCol="score", outputCol="_range").transform(df)
    # Never NULL, for the optimizer to know: a filter for it in one branch of a join would keep the
    # branches from sharing their shuffle.
    return cut.withColumn("_range", F.coalesce(F.col("_range").cast("int"), F.lit(0)))


def score_ladder(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Running counts at every distinct score, from the highest score down.

    Columns: ``by``, ``score``, ``tp``/``fp`` (rows at this score), ``tps``/``fps`` (rows at
    this score or above), ``positives``/``negatives`` (totals), ``next_tp``/``next_fp`` (rows
    at the next lower score, NULL at the end). Rows without score, label or group are left out.
    """
    by = list(by)
    usable = df.select(
        *[col(c) for c in by],
        present(score).alias("score"),
        col(label).cast("int").alias("_y"),
    ).dropna()
    merged = usable.groupBy(*by, "score").agg(
        F.count_if(F.col("_y") == 1).alias("tp"), F.count_if(F.col("_y") != 1).alias("fp")
    )
    cut = _with_range(merged, score_edges(df, score, ranges))

    # One row per range and group; a range is about a million rows, so 10^12 rows have a million ranges.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    downwards = group.orderBy(F.desc("_range"))
    higher = downwards.rowsBetween(Window.unboundedPreceding, -1)
    ranges_table = (
        cut.groupBy(*by, "_range")
        .agg(
            F.sum("tp").alias("_tp"),
            F.sum("fp").alias("_fp"),
            F.max_by(F.struct("tp", "fp"), "score").alias("_head"),
        )
        .select(
            *by,
            "_range",
            F.coalesce(F.sum("_tp").over(higher), F.lit(0)).alias("_tps_above"),
            F.coalesce(F.sum("_fp").over(higher), F.lit(0)).alias("_fps_above"),
            F.sum("_tp").over(group).alias("positives"),
            F.sum("_fp").over(group).alias("negatives"),
            F.lead("_head").over(downwards).alias("_next_head"),
        )
    )

    inside = Window.partitionBy(*by, "_range").orderBy(F.desc("score"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    steps = cut.select(
        *by,
        "_range",
        "score",
        "tp",
        "fp",
        F.sum("tp").over(running).alias("_tps"),
        F.sum("fp").over(running).alias("_fps"),
        F.lead(F.struct("tp", "fp")).over(inside).alias("_next"),
    )
    following = F.coalesce(F.col("_next"), F.col("_next_head"))
    return steps.join(ranges_table, [*by, "_range"]).select(
        *by,
        "score",
        "tp",
        "fp",
        (F.col("_tps_above") + F.col("_tps")).alias("tps"),
        (F.col("_fps_above") + F.col("_fps")).alias("fps"),
        "positives",
        "negatives",
        following["tp"].alias("next_tp"),
        following["fp"].alias("next_fp"),
    )


def auc_of_ladder(ladder: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve with its display band; groups with a single class are left out.

    Every score adds a trapezoid of width ``fp`` between the running heights, so the area
    is a plain sum over the ladder.
    """
    slab = F.col("fp") * (F.col("tps") - F.col("tp") / 2.0)
    box = F.first("positives").cast("double") * F.first("negatives").cast("double")
    return (
        ladder.filter((F.col("positives") > 0) & (F.col("negatives") > 0))
        .groupBy(*by)
        .agg((F.sum(slab) / box).alias("auc"))
        .select(
            *by,
            "auc",
            (F.col("auc") - AUC_BAND).alias("auc_low"),
            (F.col("auc") + AUC_BAND).alias("auc_high"),
        )
    )


def curve_points(ladder: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, threshold, fpr, tpr)`` without the points a straight line passes through.

    A point is on a line when the next score adds the same counts as its own; the first
    and the last score always stay. A leading ``(inf, 0, 0)`` means "nothing is positive".
    """
    is_first = (F.col("tps") == F.col("tp")) & (F.col("fps") == F.col("fp"))
    is_last = F.col("next_tp").isNull()
    bends = (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp"))
    point = F.struct(
        F.col("score").alias("threshold"),
        ratio(F.col("fps"), F.col("negatives")).alias("fpr"),
        ratio(F.col("tps"), F.col("positives")).alias("tpr"),
    )
    start = F.struct(F.lit(math.inf).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    # Every group has one last score; it also emits the start, so no second pass is needed.
    points = F.when(is_last, F.array(point, start)).otherwise(F.array(point))
    return ladder.filter(is_first | is_last | bends).select(*by, F.inline(points))


def roc_curve(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    return curve_points(score_ladder(df, score, label, by, ranges), by)


def auc(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``auc_of_ladder`` of scored rows."""
    return auc_of_ladder(score_ladder(df, score, label, by, ranges), by)


def auc_of_points(points: DataFrame, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Trapezoid area of a table of curve points.

    Points are put in order range by range of the threshold; where two ranges meet, the last point
    of one and the first of the next give the slab between them.
    """
    by = list(by)
    edges = score_edges(points.filter(F.col("threshold") < math.inf), "threshold", ranges)
    cut = _with_range(points.withColumn("score", F.col("threshold")), edges)
    order = Window.partitionBy(*by, "_range").orderBy("fpr", "tpr")
    here, before = F.struct("fpr", "tpr"), F.lag(F.struct("fpr", "tpr")).over(order)
    inside = cut.select(*by, "_range", here.alias("_p"), _slab(before, here).alias("_slab"))
    per_range = inside.groupBy(*by, "_range").agg(F.sum("_slab").alias("_slab"), F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    joints = _slab(F.lag("_last").over(group.orderBy(F.desc("_range"))), F.col("_first"))
    areas = per_range.withColumn("_joint", joints).groupBy(*by)
    return areas.agg((F.sum(F.coalesce("_slab", F.lit(0.0)) + F.coalesce("_joint", F.lit(0.0)))).alias("auc"))


def _slab(left: Column, right: Column) -> Column:
    return (right["fpr"] - left["fpr"]) * (right["tpr"] + left["tpr"]) / 2.0


def threshold_at_specificity(points: DataFrame, by: Sequence[str] = (), specificity: float = SPECIFICITY) -> DataFrame:
    """Lowest curve threshold whose specificity is still high enough, with its two rates.

    The ``(inf, 0, 0)`` point always qualifies; ``inf`` means nothing may be called positive. In a
    group with a single class the rates mean nothing: it takes the threshold 0.5, its rates are NULL
    and ``apply_threshold`` takes the plain prediction.
    """
    enough = 1.0 - F.col("fpr") >= specificity
    best = F.min_by(F.when(enough, F.struct("threshold", "tpr", "fpr")), F.when(enough, F.col("threshold")))
    scored = F.col("threshold") < math.inf
    both = F.max(F.when(scored, F.col("fpr"))).isNotNull() & F.max(F.when(scored, F.col("tpr"))).isNotNull()
    found = points.groupBy(*by).agg(best.alias("_p"), both.alias("_both"))
    return found.select(
        *by,
        F.when(F.col("_both"), F.col("_p.threshold")).otherwise(FALLBACK_THRESHOLD).alias("threshold"),
        F.when(F.col("_both"), F.col("_p.tpr")).alias("sensitivity"),
        F.when(F.col("_both"), 1.0 - F.col("_p.fpr")).alias("specificity"),
    )


def nearest_threshold(points: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Curve point closest to a given threshold, the higher one on ties."""
    target = F.lit(float(threshold))
    gap = F.when(F.col("threshold") == target, 0.0).otherwise(F.abs(F.col("threshold") - target))
    best = F.min_by(F.struct("threshold", "fpr", "tpr"), F.struct(gap, -F.col("threshold")))
    return points.groupBy(*by).agg(best.alias("_p")).select(*by, "_p.threshold", "_p.fpr", "_p.tpr")


def called(score: Column, threshold: Column) -> Column:
    return (score >= threshold).cast("int")


def apply_threshold(
    oof: DataFrame, thresholds: DataFrame, by: Sequence[str] = (), score: str = "score", out: str = "called"
) -> DataFrame:
    """1 where the score reaches the threshold of its group (or the single pooled one)."""
    if by:
        # A group with a single class has no rates; its rows keep their plain prediction.
        plain = "specificity" in thresholds.columns and "prediction" in oof.columns
        single = F.col("specificity").isNull() if plain else F.lit(False)
        table = thresholds.select(*by, F.col("threshold").alias("_threshold"), single.alias("_single"))
        matched = lookup_join(oof, table, list(by), "left")
        hit = called(col(score), F.col("_threshold"))
        if plain:
            hit = F.when(F.col("_single"), F.col("prediction").cast("int")).otherwise(hit)
        return matched.withColumn(out, hit).drop("_threshold", "_single")
    pooled = thresholds.select("threshold").scalar()
    return oof.withColumn(out, called(col(score), pooled))
