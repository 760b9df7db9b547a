"""Order in which the sources of a corpus are read, at target weights, by Pfair scheduling.

The rows of each source, shuffled by a hash, form blocks of ``block_rows`` rows. Source ``s`` has a
whole number of parts ``a(s)``; a cycle holds ``a(s)`` blocks of each source, fewer where a source
runs out. In a cycle of ``L`` blocks, block ``j`` (from 0) of the ``n`` of a source is released at
slot ``floor(j L / n)`` and due before slot ``ceil((j + 1) L / n)``; of the released blocks the one
due first takes the slot. At every slot each source has had its share ``t n / L`` of the cycle to
within less than one block, and at the end of a cycle exactly, so the deviation never adds up.

A cycle looks like the one before it unless a source runs out, so at most ``2 S + 1`` schedules are
worked out for ``S`` sources, whatever the number of rows (sources are the few parts of a mix; all of
them together fit in one row); the place of a row follows from its rank in its
source by arithmetic. Ranks come from windows inside (source, hash bucket) plus prefix sums over
buckets in two levels, so a source with a third of all rows is spread over many tasks; a bucket that
is heavy because one key (or none) repeats is cut by ranges of the hash of the other columns.

Only DataFrame functions are used. Every row is returned once, none is dropped or repeated.

Defined results: null is a source of its own; rows without a key are shuffled by the hash of the
empty text; rows that agree in all columns are interchangeable; an empty table gives no rows; the
columns ``mix_block``, ``mix_row`` and ``mix_position`` replace columns of the same names, other
columns pass through, whatever their names.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

#: Rows a hash bucket holds on average, and rows from which one is cut into parts of about so many.
BUCKET_ROWS, HEAVY = 128, 20_000

#: For each slot the source of the schedule: a fold over the slots, whose state is the number of
#: blocks each source has had and the sources so far. ``transform(array(x), p -> ...)[0]`` names x.
EDF = """
aggregate(
  sequence(0L, length - 1), named_struct('had', transform(n, x -> 0L), 'slots', cast(array() as array<bigint>)),
  (state, t) -> transform(
    array(array_min(transform(n, (x, i) ->
      if(state.had[i] < x and floor(state.had[i] * length / x) <= t,
         named_struct('due', ceil((state.had[i] + 1) * length / x), 'i', cast(i as bigint)), null))).i),
    p -> named_struct('had', transform(state.had, (h, i) -> if(i = p, h + 1, h)), 'slots', concat(state.slots, array(p)))
  )[0],
  state -> state.slots)
"""


def target_parts(sources: DataFrame, parts: int, temperature: float, weights: dict[str, int] | None) -> DataFrame:
    """``a``, the blocks of each source in a full cycle, from the columns ``s`` and ``n`` (rows)."""
    if weights is not None:
        if any(w < 1 for w in weights.values()):
            raise ValueError("weights are whole numbers of parts, at least 1")
        given = F.lit(1)
        for name, weight in weights.items():
            given = F.when(F.col("s") == name, F.lit(weight)).otherwise(given)
        return sources.withColumn("a", given.cast("long"))
    tempered = F.pow(F.col("n").cast("double"), F.lit(temperature))
    total = sources.agg(F.sum(tempered)).first()[0] or 1.0
    return sources.withColumn("a", F.greatest(F.lit(1), F.round(F.lit(float(parts)) * tempered / F.lit(total))).cast("long"))


def schedules(sources: DataFrame) -> DataFrame:
    """For each source ``s`` its ``a``, the cycles where the schedule changes (``breaks``) and for each of them
    the blocks before it (``before``), the length of its cycles (``lengths``) and the slots of the source (``own``).

    ``sources`` has one row per source: ``s``, ``blocks`` and ``a``.
    """
    full = F.expr("blocks div a")
    everything = sources.agg(
        F.array_sort(F.collect_list(F.struct("s", "blocks", "a"))).alias("all"),
        F.array_sort(F.array_union(F.array(F.lit(0).cast("long")), F.flatten(F.collect_set(F.array(full, full + 1))))).alias("breaks"),
    )
    cycles = everything.select("all", "breaks", F.explode("breaks").alias("b"))
    cycles = cycles.selectExpr(
        "all", "breaks", "b",
        "transform(all, x -> greatest(0L, least(x.a, x.blocks - b * x.a))) n",
        "aggregate(all, 0L, (t, x) -> t + least(x.blocks, b * x.a)) before",
    ).selectExpr("*", "aggregate(n, 0L, (t, x) -> t + x) length")
    cycles = cycles.selectExpr("*", f"if(length = 0, cast(array() as array<bigint>), {EDF}) slots")
    per_source = cycles.select("breaks", "b", "before", "length", "slots", F.posexplode("all").alias("i", "x"))
    own = "filter(transform(slots, (p, t) -> if(p = i, cast(t as bigint), null)), t -> t is not null)"
    return (
        per_source.selectExpr("x.s s", "x.a a", "breaks", "named_struct('b', b, 'before', before, 'length', length, 'own', " + own + ") one")
        .groupBy("s", "a", "breaks")
        .agg(F.array_sort(F.collect_list("one")).alias("each"))
        .selectExpr("s", "a", "breaks", "each.before before", "each.length lengths", "each.own own")
    )


def _parted(rows: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with ``_mix_part``, which cuts heavy buckets, and the rows ``ahead`` of each part in its bucket (None: no heavy one).

    A hash spreads keys evenly, so a bucket is heavy where one key repeats: rows of one hash are
    cut by ranges of their ties, which order them. Elsewhere a bucket is one part.
    """
    heavy = staged(counts.where(F.col("n") > HEAVY).select(F.col("_mix_s").alias("_mix_hs"), F.col("_mix_bucket").alias("_mix_hb"), F.col("n").alias("_mix_hn")), "mix-heavy")
    if heavy.isEmpty():
        return rows.withColumn("_mix_part", F.lit("")), None
    # Sorts like (hash, tie range): both have a fixed number of digits.
    pieces = F.least(F.ceil(F.col("_mix_hn") / F.lit(HEAVY)), F.lit(1 << 20))
    span = F.floor((F.shiftrightunsigned("_mix_tie_up", 32) * pieces) / F.lit(1 << 32))
    marked = rows.withColumn("_mix_tie_up", F.col("_mix_tie").bitwiseXOR(F.lit(-(1 << 63))))
    marked = marked.join(heavy, F.col("_mix_s").eqNullSafe(F.col("_mix_hs")) & (F.col("_mix_bucket") == F.col("_mix_hb")), "left")
    marked = marked.withColumn("_mix_part", F.when(F.col("_mix_hn").isNull(), "").otherwise(F.concat("_mix_h", F.lpad(span.cast("string"), 8, "0"))))
    rows = marked.drop("_mix_hs", "_mix_hb", "_mix_hn", "_mix_tie_up")
    sizes = rows.where("_mix_part <> ''").groupBy(F.col("_mix_s").alias("_mix_qs"), F.col("_mix_bucket").alias("_mix_qb"), F.col("_mix_part").alias("_mix_qp")).agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("_mix_qs", "_mix_qb").orderBy("_mix_qp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return rows, staged(sizes.select("_mix_qs", "_mix_qb", "_mix_qp", ahead.alias("_mix_ahead")), "mix-parts")


def _ranked(rows: DataFrame, bits: int) -> DataFrame:
    """``rank`` (from 0) of each row in its source ``_mix_s`` by the hash ``_mix_h`` (hex digits), ties by ``_mix_tie``."""
    bucket = F.conv(F.substring("_mix_h", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_mix_bucket", F.shiftright(bucket, 32 - bits))
    counts = rows.groupBy("_mix_s", "_mix_bucket").agg(F.count("*").alias("n")).withColumn("above", F.shiftright("_mix_bucket", (bits + 1) // 2))
    counts = staged(counts, "mix-buckets")
    rows, parts = _parted(rows, counts)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    tops = counts.groupBy(F.col("_mix_s").alias("ts"), F.col("above").alias("ta")).agg(F.sum("n").alias("n"))
    tops = tops.select("ts", "ta", F.coalesce(F.sum("n").over(before.partitionBy("ts").orderBy("ta")), zero).alias("first"))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("_mix_s", "above").orderBy("_mix_bucket")), zero)
    starts = counts.withColumn("_mix_start", inner).join(tops, F.col("_mix_s").eqNullSafe(F.col("ts")) & (F.col("above") == F.col("ta")))
    starts = staged(starts.select(F.col("_mix_s").alias("_mix_bs"), F.col("_mix_bucket").alias("_mix_bb"), (F.col("_mix_start") + F.col("first")).alias("_mix_start")), "mix-starts")
    place = F.row_number().over(Window.partitionBy("_mix_s", "_mix_bucket", "_mix_part").orderBy("_mix_h", "_mix_tie")) - 1
    placed = rows.withColumn("_mix_place", place.cast("long") + zero)
    if parts is not None:
        same = F.col("_mix_s").eqNullSafe(F.col("_mix_qs")) & (F.col("_mix_bucket") == F.col("_mix_qb")) & (F.col("_mix_part") == F.col("_mix_qp"))
        placed = placed.join(parts, same, "left").withColumn("_mix_place", F.col("_mix_place") + F.coalesce("_mix_ahead", zero)).drop("_mix_qs", "_mix_qb", "_mix_qp", "_mix_ahead")
    joined = placed.join(starts, F.col("_mix_s").eqNullSafe(F.col("_mix_bs")) & (F.col("_mix_bucket") == F.col("_mix_bb")))
    return joined.withColumn("_mix_rank", F.col("_mix_place") + F.col("_mix_start"))


def _block_place(block: Column) -> Column:
    """Place of a source's block among all blocks, from the schedules joined to its row."""
    return F.transform(
        F.array(F.struct(F.floor(block / F.col("_mix_a")).alias("c"), (block % F.col("_mix_a")).alias("k"))),
        lambda at: F.transform(
            # The last schedule that begins at or before the block's cycle.
            F.array(F.size(F.filter("_mix_breaks", lambda b: b <= at["c"])) - 1),
            lambda i: F.get("_mix_before", i) + (at["c"] - F.get("_mix_breaks", i)) * F.get("_mix_lengths", i) + F.get(F.get("_mix_own", i), at["k"].cast("int")),
        )[0],
    )[0]


def mix_sources(
    docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict[str, int] | None = None,
    block_rows: int = 64, parts: int = 200, temperature: float = 0.5,
) -> DataFrame:
    """``docs`` with ``mix_block`` (place of the row's block among all blocks), ``mix_row`` (its place in
    the block) and ``mix_position`` (ascending in reading order, with gaps behind short blocks).

    ``weights`` gives whole parts per source (a source without one has 1 part). Without it a source
    of ``n`` rows gets ``parts * n**temperature / sum(n**temperature)`` parts, rounded, at least one.
    """
    columns = [c for c in docs.columns if c not in ("mix_block", "mix_row", "mix_position")]
    sources = staged(docs.groupBy(F.col(source).alias("s")).agg(F.count("*").alias("n")), "mix-sources")
    total = sources.agg(F.sum("n")).first()[0] or 0
    sources = target_parts(sources, parts, temperature, weights).withColumn("blocks", F.ceil(F.col("n") / block_rows))
    plan = staged(schedules(sources), "mix-schedules")
    # Own names, which cannot meet columns of the documents.
    plan = plan.select(F.col("s").alias("_mix_ps"), *[F.col(c).alias(f"_mix_{c}") for c in ("a", "breaks", "before", "lengths", "own")])

    rows = docs.select(*columns, F.col(source).alias("_mix_s"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("_mix_h"))
    rows = rows.withColumn("_mix_tie", F.xxhash64(*[F.col(c) for c in columns]))
    ranked = _ranked(rows, min(30, max(0, ceil(log2(max(total, 1) / BUCKET_ROWS)))))
    placed = ranked.join(plan, F.col("_mix_s").eqNullSafe(F.col("_mix_ps")))
    block = _block_place(F.floor(F.col("_mix_rank") / block_rows))
    return placed.select(*columns, block.alias("mix_block"), (F.col("_mix_rank") % block_rows).alias("mix_row")).withColumn(
        "mix_position", F.col("mix_block") * block_rows + F.col("mix_row")
    )


ORACLE_SQL = """
with recursive src as (
  select source, count(*) n from documents group by source
), p as (
  select source, n, cast(ceil(n / 64.0) as bigint) blocks, cast(greatest(1, round(200.0 * sqrt(n) / (select sum(sqrt(n)) from src))) as bigint) a,
         row_number() over (order by source nulls first) - 1 i from src
), breaks as (
  select distinct b from (select cast(0 as bigint) b union all select blocks // a from p union all select blocks // a + 1 from p)
), cycles as (
  select b, list(greatest(0, least(a, blocks - b * a)) order by i) n, sum(least(blocks, b * a))::bigint off,
         sum(greatest(0, least(a, blocks - b * a)))::bigint len, lead(b) over (order by b) nxt from breaks, p group by b
), sim(b, t, had, pick) as (
  select b, cast(-1 as bigint), list_transform(n, lambda x: cast(0 as bigint)), cast(-1 as bigint) from cycles
  union all
  select b, t, list_transform(had, lambda x, k: x + case when k - 1 = pick then 1 else 0 end), pick from (
    select s.b, s.t + 1 t, s.had, list_min(list_filter(list_transform(s.had, lambda h, k:
             case when h < c.n[k] and (h * c.len) // c.n[k] <= s.t + 1 then ((((h + 1) * c.len + c.n[k] - 1) // c.n[k]) * 1000000 + k - 1) else null end),
             lambda x: x is not null)) % 1000000 pick
    from sim s join cycles c using (b) where s.t + 1 < c.len)
), slots as (
  select b, pick i, t, row_number() over (partition by b, pick order by t) - 1 k from sim where t >= 0
), ranked as (
  select doc_id, source, row_number() over (partition by source order by md5(doc_id::varchar)) - 1 r from documents
), placed as (
  select r.doc_id, r.source, r.r % 64 mix_row, (r.r // 64) // p.a c, (r.r // 64) % p.a k, p.i from ranked r join p on r.source is not distinct from p.source
)
select x.doc_id, x.source, (y.off + (x.c - y.b) * y.len + z.t)::bigint mix_block, x.mix_row::bigint mix_row,
       ((y.off + (x.c - y.b) * y.len + z.t) * 64 + x.mix_row)::bigint mix_position
from placed x join cycles y on x.c >= y.b and (y.nxt is null or x.c < y.nxt) join slots z on z.b = y.b and z.i = x.i and z.k = x.k
"""
