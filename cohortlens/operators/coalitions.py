"""Feature attributions by kernel regression over coalitions of features.

A coalition's value for a row is the mean score when the row's features in the coalition meet the
others of every background row. Attributions are the weighted least squares fit of these values by
sums over the coalition's members, weighted by the Shapley kernel, under the condition that base and
attributions add up to the row's score. All rows share their coalitions, so the fit is the same linear
map for each: its coefficients are solved once from a features x features system, and the normal
equations of all rows and classes become one aggregation of coalition values.

Small and large coalitions are all used as far as the budget goes (a size together with its
counterpart, most weight first), the rest is drawn in pairs of a coalition and its complement. With
all ``2^d - 2`` of them the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import col
from cohortlens.operators.explain import COPIES_PER_TASK, _number_background
from cohortlens.operators.folds import SEED
from cohortlens.operators.lookup import lookup_join

#: Coalitions drawn by default besides two per feature.
DRAWN = 2_048


def choose(d: int, budget: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions (rows of 0 and 1) and their weights; at least those of one feature and of all but one."""
    sizes = {s: (d - 1) / (s * (d - s)) for s in range(1, d)}
    found: dict[tuple[int, ...], float] = {}
    left = max(budget, 2 * d)
    for s in range(1, d // 2 + 1):
        both = {s, d - s}
        if sum(math.comb(d, t) for t in both) > left:
            break
        for t in both:
            weight = sizes.pop(t) / math.comb(d, t)
            found |= {members: weight for members in combinations(range(d), t)}
            left -= math.comb(d, t)
    pairs = left // 2 if sizes else 0
    if pairs:
        rng = np.random.default_rng(seed)
        names, total = list(sizes), sum(sizes.values())
        share = np.array([sizes[s] for s in names]) / total
        for s in rng.choice(names, pairs, p=share):
            members = tuple(sorted(rng.choice(d, s, replace=False).tolist()))
            for one in (members, tuple(j for j in range(d) if j not in set(members))):
                found[one] = found.get(one, 0.0) + total / (2 * pairs)
    masks = np.zeros((len(found), d), np.int8)
    for i, members in enumerate(found):
        masks[i, list(members)] = 1
    return masks, np.array(list(found.values()))


def coefficients(masks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per coalition what its value adds to every attribution, and the same for the row's own score.

    Attributions are ``values @ first + score * second - base * (sum of both)``.
    """
    d = masks.shape[1]
    if not len(masks):
        return np.zeros((0, d)), np.full(d, 1.0 / d)
    z = masks.astype(float)
    inverse = np.linalg.inv(z.T @ (weights[:, None] * z))
    ones = inverse.sum(axis=1)
    free = inverse - np.outer(ones, ones) / ones.sum()
    return (free @ (z.T * weights)).T, ones / ones.sum()


def kernel_attributions(
    df: DataFrame,
    features: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    background: DataFrame,
    key: str = "row_id",
    budget: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``row_id, class, feature, value, phi, base`` as ``explain.shapley_attributions`` gives them.

    ``budget`` is the number of coalitions (default: ``2 d + DRAWN``, or all of them if they are
    fewer; never under ``2 d``); every row meets every background row once per coalition. The key
    must be unique. Neither rows nor background have a largest size. No rows give no attributions;
    an empty background is an error, as is an empty list of features.
    """
    d, tasks = len(features), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not d:
        raise ValueError("there are no features to explain")
    numbered, n_background = _number_background(background, features, key)
    if n_background == 0:
        raise ValueError("the background has no rows")
    masks, weights = choose(d, 2 * d + DRAWN if budget is None else budget, seed)
    adds, own = coefficients(masks, weights)
    # The last coalition holds all features: its value is the row's own score.
    masks, adds = np.vstack([masks, np.ones((1, d), np.int8)]), np.vstack([adds, own])
    spark, n = df.sparkSession, len(masks)
    members = spark.createDataFrame([(i, [bool(v) for v in m]) for i, m in enumerate(masks)], "m int, members array<boolean>")
    parts = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(adds)], "m int, adds array<double>")

    values = F.array(*[col(f).cast("double") for f in features])
    rows = df.select(col(key).alias("row_id"), values.alias("row_x"))
    copies = df.count() * n * n_background
    # A task holds whole (row, coalition) groups, so their means need no further shuffle.
    grid = rows.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(max(tasks, math.ceil(copies / COPIES_PER_TASK)), "row_id", "m")
    met = lookup_join(grid, members, ["m"], "inner").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_background - 1))))
    paired = lookup_join(met, numbered, ["b"], "inner")
    positions = F.sequence(F.lit(0), F.lit(d - 1))
    x = F.transform(positions, lambda j: F.when(F.get("members", j), F.get("row_x", j)).otherwise(F.get("background_x", j)))
    scored = score(paired.select("row_id", "m", x.alias("x"))).select("row_id", "m", F.posexplode("scores").alias("class", "f"))
    means = scored.groupBy("row_id", "m", "class").agg(F.avg("f").alias("v"))
    spread = lookup_join(means, parts, ["m"], "inner").select("row_id", "class", "v", F.posexplode("adds").alias("j", "a"))
    summed = spread.groupBy("row_id", "class", "j").agg(F.sum(F.col("a") * F.col("v")).alias("total"))
    start = score(numbered.select(F.col("background_x").alias("x")))
    base = start.select(F.posexplode("scores").alias("class", "f")).groupBy("class").agg(F.avg("f").alias("base"))
    names, shares = F.array(*[F.lit(f) for f in features]), F.array(*[F.lit(float(v)) for v in adds.sum(axis=0)])
    known = lookup_join(lookup_join(summed, base, ["class"], "inner"), rows, ["row_id"], "inner")
    return known.select(
        "row_id",
        "class",
        F.get(names, F.col("j")).alias("feature"),
        F.get("row_x", F.col("j")).alias("value"),
        (F.col("total") - F.col("base") * F.get(shares, F.col("j"))).alias("phi"),
        "base",
    )
