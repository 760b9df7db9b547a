"""Near-duplicates by SimHash fingerprints that differ in few bits.

Candidates come from an inverted index on byte positions with count filtering. Fingerprints that
differ in at most ``distance`` bits differ in at most that many of their eight bytes, so a pair
must share at least ``8 - distance`` bytes at the same position. One list per single byte would
hold a 256th of all fingerprints and its tallies would grow with the square of the corpus, so the
index keeps the lists of ``8 - distance`` positional bytes at once: two fingerprints meet in such a
list exactly if their tally reaches the guaranteed minimum. Every pair found is then verified by
the bits that differ.

Two fingerprints of one list can differ only in the ``distance`` bytes outside it, so a list of
distinct fingerprints holds at most ``256 ** distance`` of them whatever the corpus: 65,536 for
two. In a list of more than some hundred each one's possible neighbours are looked up among the
sorted others, in shorter ones all are compared; only a spanning forest of the links leaves the task.

Defined results: a null text is the empty one; a text without words has fingerprint zero and is
linked like any other; every row gives one row; exact copies share one fingerprint and add one row
to the index; rows without a key take part but never name a component (a group of such rows only
has a null component). ``keep_one`` chooses a row, not a key: a key that other groups hold too neither
costs them their row nor brings a copy back. Empty tables give no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged
from cohortlens.llm.components import components

#: Shingles hashed at a time: bounds the memory for a very long text.
CHUNK = 1 << 18
#: Fixed by the fingerprint: bits of each byte value, lowest first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: a bit is set if it is set in over half the shingle hashes."""
    # bytes.lower changes A-Z only; bytes.split separates at the six ASCII blanks.
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(tokens) - words + 1, 1)
    ends = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros((8, 256), np.int64)
    places = (np.arange(8) * 256)[None, :]
    for low in range(0, last, CHUNK):
        high = min(low + CHUNK, last)
        spans = zip(starts[low:high].tolist(), ends[low:high].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        # Byte histograms of each position instead of 64 counters a shingle.
        cells = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + places
        counts += np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
    set_in = (counts @ BITS).ravel()
    return int(sum(1 << i for i in np.flatnonzero(2 * set_in > last).tolist()))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, row: bool = False) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a long) of every row; with ``row`` also the digests that tell rows apart."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(v.as_py() or b"", words) for v in batch.column(1)), np.uint64, batch.num_rows)
            columns = [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["k", "fp", "text_md5", "rest_hash"][: len(columns)])

    own = _row(docs, key, text)
    rows = docs.select(own["k"], F.col(text).cast("binary").alias("t"), *([own["text_md5"], own["rest_hash"]] if row else []))
    return rows.mapInArrow(compute, "k long, fp long" + (", text_md5 binary, rest_hash long" if row else ""))


def _row(docs: DataFrame, key: str, text: str) -> dict[str, Column]:
    """Key, digest of the text (empty for a null) and hash of the other columns: rows that agree in all are the same row."""
    rest = [F.col(c) for c in docs.columns if c not in (key, text)]
    return {
        "k": F.col(key).cast("long").alias("k"),
        "text_md5": F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b"")).alias("text_md5"),
        "rest_hash": (F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")).alias("rest_hash"),
    }


def _masks(distance: int) -> np.ndarray:
    """All non-zero changes of at most ``distance`` bits within ``8 * distance`` bits."""
    bits = range(8 * distance)
    return np.array([sum(1 << i for i in chosen) for n in range(1, distance + 1) for chosen in combinations(bits, n)], np.int64)


def _forest(rest: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """For distinct values, the smallest value reachable by steps in ``masks``."""
    values = np.sort(rest)
    root = np.arange(len(values))
    steps = []
    if len(values) <= len(masks):
        left, right = np.nonzero(np.isin(values[:, None] ^ values[None, :], masks))
        steps.append((left, right))
    else:
        for mask in masks:
            place = np.minimum(np.searchsorted(values, values ^ mask), len(values) - 1)
            left = np.flatnonzero(values[place] == (values ^ mask))
            steps.append((left, place[left]))
    while True:
        before = root.copy()
        for left, right in steps:
            np.minimum.at(root, left, root[right])
        root = root[root]
        if np.array_equal(root, before):
            return values[root[np.searchsorted(values, rest)]]


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Spanning links ``a``, ``b`` between the distinct fingerprints (column ``fp``) at most ``distance`` bits apart."""
    if not 1 <= distance <= 2:
        raise ValueError("lists are bounded for a distance of 1 or 2 bits")
    masks = _masks(distance)
    kept = list(combinations(range(8), 8 - distance))
    keep = [sum(0xFF << (8 * p) for p in c) for c in kept]
    signed = [m - (1 << 64) if m >> 63 else m for m in keep]
    outside = [[p for p in range(8) if p not in c] for c in kept]
    postings = distinct.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("positions", "bytes"),
    )
    lists = postings.groupBy("positions", "bytes").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for position, fps in zip(batch.column(0), batch.column(1)):
                values = np.array(fps.as_py(), np.int64).view(np.uint64)
                if len(values) == 2:  # nearly all lists
                    if int(values[0] ^ values[1]).bit_count() <= distance:
                        a.append(fps[0].as_py())
                        b.append(fps[1].as_py())
                    continue
                free = outside[position.as_py()]
                rest = sum((((values >> np.uint64(8 * p)) & np.uint64(0xFF)).astype(np.int64) << (8 * i)) for i, p in enumerate(free))
                root = _forest(rest, masks)
                order = np.argsort(rest)
                first = values[order[np.searchsorted(rest[order], root)]]
                moved = first != values
                a += values[moved].view(np.int64).tolist()
                b += first[moved].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lists.select("positions", "fps").mapInArrow(linked, "a long, b long")


def _rooted(named: DataFrame, distance: int) -> DataFrame:
    """``named`` (distinct fingerprints ``fp`` and other columns) with the ``root`` fingerprint of each one's group."""
    joined = components(links(named, distance))
    return named.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest key reachable) of every row."""
    prints = staged(fingerprints(docs, key, text, words), "fingerprints")
    named = staged(prints.groupBy("fp").agg(F.min("k").alias("least")), "distinct-fingerprints")
    # A component is known by its root fingerprint; its name is the smallest key in it.
    members = _rooted(named, distance)
    names = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(members.select("fp", "root").join(names, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select(
        F.col("k").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2, unkeyed_stay: bool = True) -> DataFrame:
    """One row of each group: the one with the smallest key, then the smallest digest of its text.

    The choice is by row: rows that repeat a key in other groups neither bring a row back nor cost
    another group its own. Rows without a key all stay, and groups are those of the other rows;
    without ``unkeyed_stay`` they come last in their group like any other row.
    """
    rows = fingerprints(docs, key, text, words, row=True).groupBy("fp", "k", "text_md5", "rest_hash").agg(F.count("*").alias("n"))
    row = F.struct(F.col("k").isNull().alias("unkeyed"), "k", "text_md5", "rest_hash", "n")
    choice = F.min(F.when(F.col("k").isNotNull(), row) if unkeyed_stay else row)
    named = staged(rows.groupBy("fp").agg(choice.alias("first")), "distinct-fingerprints")
    chosen = _rooted(named, distance).groupBy("root").agg(F.min("first").alias("first")).where("first is not null")
    chosen = staged(chosen.select(*[F.col(f"first.{c}").alias(f"_kept_{c}") for c in ("k", "text_md5", "rest_hash", "n")]), "kept-rows")
    own = _row(docs, key, text)
    every = docs.select("*", *[c.alias(f"_own_{name}") for name, c in own.items()])
    same = F.col("_own_k").eqNullSafe(F.col("_kept_k")) & (F.col("_own_text_md5") == F.col("_kept_text_md5")) & (F.col("_own_rest_hash") == F.col("_kept_rest_hash"))
    kept = every.join(chosen.where("_kept_n = 1"), same, "left_semi").select(*docs.columns)
    if not chosen.where("_kept_n > 1").isEmpty():
        # Rows that agree in everything: one of them. The group is written in other terms than the
        # join's, so that copies are combined before they are dealt out.
        again = every.join(chosen.where("_kept_n > 1"), same, "left_semi")
        group = F.concat_ws("-", "_own_k", F.hex("_own_text_md5"), "_own_rest_hash").alias("_own_row")
        kept = kept.unionByName(again.groupBy(group).agg(F.first(F.struct(*docs.columns)).alias("_one")).select("_one.*"))
    return kept.unionByName(docs.where(own["k"].isNull())) if unkeyed_stay else kept
