"""Near-duplicate vectors by random-hyperplane signs, exact cosines and distributed components.

Each of ``tables`` tables cuts space by ``bits`` random hyperplanes; vectors of one label on the same
side of all planes of a table meet in a bucket. Two vectors at cosine 0.98 agree on one plane with
probability 0.936, so with 16 planes they meet in a table with probability 0.35 and are missed by
all 48 tables with one of 1e-9. Every pair that meets is verified by its cosine in double precision
and counted in the first table where it meets only.

Exact copies are one vector with a weight before they are hashed. Buckets of one vector are dropped
by a count, and of buckets with the same members, as near copies have them in many tables, the first
table's stays: its pairs meet there or earlier. Members are node numbers; a vector and its buckets are
joined to them as bytes once they are spread over units. A larger bucket is cut into blocks of about ``block_rows`` vectors, and each pair of
blocks is one unit of work, so a bucket with a third of all vectors is spread over many tasks; of a
unit only the number of links of each vector and a spanning forest leave the task, never its pairs.

Defined results: vectors without a label, null or empty ones, and those with null or non-finite
components or without a non-zero one link with nothing; so do vectors of different lengths. Rows are
vectors: two rows with equal vectors (and labels) are linked, also under one id. Every row gives one
row; a component is named by its smallest id that is not null (null if there is none). An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from cohortlens.llm.common import staged
from cohortlens.llm.components import components

#: Rows of a unit group handed to one Python call, on average.
UNIT_ROWS = 8_000


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that squares cannot overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planes(size: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).normal(size=(size, tables * bits))


def _kinds(bits: int, narrow: bool) -> tuple[np.dtype, np.dtype]:
    """Numbers in which the bytes of vectors and of codes are kept; single precision only where the input has it."""
    return np.dtype("<f4" if narrow else "<f8"), np.dtype("<u2" if bits <= 16 else "<i4")


def _codes(vectors: DataFrame, tables: int, bits: int, seed: int, narrow: bool) -> DataFrame:
    """``node``, ``codes`` (its bucket in each table), and the bytes of its vector and codes."""
    of_vector, of_codes = _kinds(bits, narrow)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits)
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(1)], int)
            codes, blobs = np.zeros((batch.num_rows, tables), np.int64), [b""] * batch.num_rows
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size not in cuts:
                    cuts[size] = planes(size, tables, bits, seed)
                raw = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                codes[at] = ((unit_vectors(raw) @ cuts[size] > 0).reshape(len(at), tables, bits) * powers).sum(axis=2)
                for i, row in zip(at.tolist(), raw.astype(of_vector)):
                    blobs[i] = row.tobytes()
            packed = [row.tobytes() for row in codes.astype(of_codes)]
            columns = [batch.column(0), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(blobs, pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "codes", "blob", "packed"])

    return vectors.select("node", "vec").mapInArrow(sign, "node long, codes array<int>, blob binary, packed binary")


def _read(rows: pd.DataFrame, kinds: tuple[np.dtype, np.dtype]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and codes of rows of one length."""
    vectors, codes = (np.frombuffer(b"".join(rows[c]), kind).reshape(len(rows), -1) for c, kind in zip(("blob", "packed"), kinds))
    return unit_vectors(vectors), codes


def _linked(left: pd.DataFrame, right: pd.DataFrame | None, table: int, threshold: float, kinds: tuple[np.dtype, np.dtype]):
    """Places of linked pairs (in the unit's rows) that do not share an earlier table."""
    x, codes = _read(left, kinds)
    if right is None:
        y, other, shift = x, codes, 0
    else:
        (y, other), shift = _read(right, kinds), len(left)
    i, j = np.nonzero(x @ y.T >= threshold)
    if right is None:
        i, j = i[i < j], j[i < j]
    # Exact: the sum of the product is taken again for the pair alone, as it is without a block.
    keep = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    i, j = i[keep], j[keep]
    first = np.ones(len(i), bool)
    for low in range(0, len(i), 1 << 16):
        part = slice(low, low + (1 << 16))
        first[part] = ~(codes[i[part], :table] == other[j[part], :table]).any(axis=1)
    return i[first], j[first] + shift


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if np.array_equal(root, before):
            return root


def _link_units(members: DataFrame, threshold: float, groups: int, kinds: tuple[np.dtype, np.dtype]) -> DataFrame:
    """Links of all units: rows (node, -1, number of linked rows) and rows (node, root, 0) of spanning forests."""

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, table, _, _, a, b), unit in rows.groupby(["label", "tbl", "code", "size", "a", "b"], sort=False):
            if len(unit) < 2:
                continue
            if a == b:
                i, j = _linked(unit, None, table, threshold, kinds)
            else:
                left, right = unit[unit["salt"] == a], unit[unit["salt"] == b]
                if not len(left) or not len(right):
                    continue
                i, j = _linked(left, right, table, threshold, kinds)
                unit = pd.concat([left, right])
            if not len(i):
                continue
            nodes, weights = unit["node"].to_numpy(), unit["weight"].to_numpy()
            counts = np.bincount(i, weights[j], len(unit)) + np.bincount(j, weights[i], len(unit))
            seen = np.flatnonzero(counts)
            out.append(pd.DataFrame({"a": nodes[seen], "b": -1, "n": counts[seen].astype(np.int64)}))
            root = _forest(len(unit), i, j)
            moved = np.flatnonzero(root != np.arange(len(unit)))
            out.append(pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]], "n": 0}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")

    key = F.pmod(F.xxhash64("label", "tbl", "code", "size", "a", "b"), F.lit(groups))
    return members.withColumn("g", key).groupBy("g").applyInPandas(verify, "a long, b long, n long")


def embedding_groups(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98,
    tables: int = 48, bits: int = 16, block_rows: int = 256, seed: int = 7,
) -> DataFrame:
    """``key``, ``n_links`` (other rows linked directly) and ``component_id`` (smallest key reachable) of every row."""
    narrow = rows.schema[vector].dataType == ArrayType(FloatType(), rows.schema[vector].dataType.containsNull)
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")), F.lit(False))) & F.exists(vec, lambda v: v != 0)
    valid = F.coalesce(F.col(label).isNotNull() & finite, F.lit(False))
    rows = rows.select(F.col(key).alias("k"), F.col(label).cast("string").alias("label"), vec.alias("vec"), valid.alias("valid"))
    distinct = rows.where("valid").groupBy("label", "vec").agg(F.min("k").alias("least"), F.count("*").alias("weight"))
    # Written once, so that the numbers stay.
    distinct = staged(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    codes = staged(_codes(distinct, tables, bits, seed, narrow), "signs")

    spread = codes.select("node", "codes").join(distinct.select("node", "label", F.size("vec").alias("size")), "node")
    bucket = ["label", "size", "tbl", "code"]
    spread = staged(spread.select("node", "label", "size", F.posexplode("codes").alias("tbl", "code")), "buckets")
    # Two digests tell sets of members apart; equal sets keep the first table.
    digests = [F.bit_xor(F.xxhash64(F.col("node"), F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    counts = spread.groupBy(*bucket).agg(F.count("*").alias("n"), *digests).where("n > 1")
    first = counts.groupBy("label", "size", "n", "x1", "x2").agg(F.min(F.struct("tbl", "code")).alias("at"))
    counts = staged(first.select("label", "size", "at.tbl", "at.code", "n"), "bucket-sizes")
    members = spread.join(counts, bucket).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    members = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("node", *bucket, "salt", F.least("salt", "other").alias("a"), F.greatest("salt", "other").alias("b"))
    work = counts.agg(F.sum(F.col("n") * F.ceil(F.col("n") / block_rows))).first()[0] or 0
    payload = codes.select("node", "blob", "packed").join(distinct.select("node", "weight"), "node")
    members = members.join(payload, "node")
    spark = rows.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-work // UNIT_ROWS))
    found = staged(_link_units(members, threshold, groups, _kinds(bits, narrow)), "vector-links")

    links = found.where("b = -1").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    joined = components(found.where("b >= 0").select("a", "b"))
    named = distinct.join(links, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    result = named.select("label", "vec", "root", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links")).join(names, "root")
    result = staged(result.select("label", "vec", "n_links", "component_id"), "vector-groups")
    linked = rows.where("valid").join(result, ["label", "vec"]).select("k", "n_links", "component_id")
    alone = rows.where(~F.col("valid")).select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("k", key)
