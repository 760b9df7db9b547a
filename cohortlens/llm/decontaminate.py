"""Benchmark passages inside documents, found by greedy string tiling.

Words (runs of word characters, lower case) are numbered by the vocabulary of the test items.
Running Karp-Rabin hashes of every window of ``min_match`` words of a document are looked up in
the hashes of the items; equal words behind equal hashes seed a match, seeds on one diagonal join
to maximal matches, and the longest match whose words are unmarked on both sides is marked again
and again until none of ``min_match`` words is left. The marked share of an item's words is its
coverage: as tiles may come in any order, reordered passages count as well as verbatim ones.

Documents never move: the items are the stated query set, taken in blocks of at most
``BLOCK_WORDS`` words, and each block is broadcast to one pass over the documents. Work per
document is linear in its words but for the tiles of items it really shares windows with.

Defined results: null and empty texts match nothing; an item shorter than ``min_match`` words is
looked for as a whole; items without words are skipped; rows with the same item text are separate
items; every pair of a document row and an item row that reaches the threshold gives one row, so
repeated rows repeat their pairs. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of test items in one broadcast block (8 bytes a word and as much for its seed), and their code points.
BLOCK_WORDS, BLOCK_POINTS = 1_000_000, 16_000_000
WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
TILES = "array<struct<item_word:int,words:int,start:bigint,end:bigint>>"
PAIRS = f"k long, item long, coverage double, matched_words int, item_words int, tiles {TILES}"
PAIRS_ARROW = pa.schema(
    [("k", pa.int64()), ("item", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("item_words", pa.int32()),
     ("tiles", pa.list_(pa.struct([("item_word", pa.int32()), ("words", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))]
)


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64) of all windows of ``width`` words."""
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for j in range(width):
        out = out * BASE + ids[j : j + len(out)]
    return out


class Items:
    """The seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.keys, self.words, self.vocabulary, self.seeds = [], [], {}, {}
        for key, text in items:
            words = WORD.findall((text or "").lower())
            if words:
                self.keys.append(key)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64))
        by_width: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n, ids in enumerate(self.words):
            by_width.setdefault(min(min_match, len(ids)), []).append((ids, n))
        for width, group in by_width.items():
            hashes = np.concatenate([window_hashes(ids, width) for ids, _ in group])
            owner = np.concatenate([np.full(len(ids) - width + 1, n) for ids, n in group])
            place = np.concatenate([np.arange(len(ids) - width + 1) for ids, _ in group])
            order = np.argsort(hashes, kind="stable")
            self.seeds[width] = (hashes[order], owner[order], place[order])

    def numbered(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Item, window width and the places of equal windows in the item and the document."""
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for width, (hashes, owner, place) in self.seeds.items():
            if len(ids) < width:
                continue
            at = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(at):
                continue
            found = window_hashes(ids, width)[at]
            low = np.searchsorted(hashes, found)
            hit = hashes[np.minimum(low, len(hashes) - 1)] == found
            at, found, low = at[hit], found[hit], low[hit]
            if not len(at):
                continue
            n = np.searchsorted(hashes, found, "right") - low
            seed = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            items, i, j = owner[seed], place[seed], np.repeat(at, n)
            order = np.argsort(items, kind="stable")
            items, i, j = items[order], i[order], j[order]
            cuts = np.flatnonzero(np.diff(items)) + 1
            for part in np.split(np.arange(len(items)), cuts):
                own, pi, pj = int(items[part[0]]), i[part], j[part]
                same = np.all([self.words[own][pi + x] == ids[pj + x] for x in range(width)], axis=0)
                if same.any():
                    yield own, width, pi[same], pj[same]


def tile(i: np.ndarray, j: np.ndarray, width: int, item_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, words): longest first, then earliest."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.concatenate(([True], (np.diff(j - i) != 0) | (np.diff(i) != 1)))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(i))) + width - 1
    heap = list(zip((-length).tolist(), i[first].tolist(), j[first].tolist()))
    heapq.heapify(heap)
    base = int(j.min())
    in_item, in_doc = np.zeros(item_words, bool), np.zeros(int(j.max()) + width - base, bool)
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = ~(in_item[a : a - n] | in_doc[b - base : b - base - n])
        if free.all():
            in_item[a : a - n] = in_doc[b - base : b - base - n] = True
            tiles.append((a, b, -n))
            if in_item.all():
                break
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if high - low >= width:
                heapq.heappush(heap, (low - high, a + low, b + low))
    return sorted(tiles)


def contaminated_pairs(items: Items, text: str, coverage: float) -> Iterator[tuple[int, float, int, int, list[dict]]]:
    """Item key, coverage, marked words, words of the item and tiles for each item ``text`` covers enough."""
    words = WORD.findall(text.lower())
    ids = items.numbered(words)
    spans = None
    for own, width, i, j in items.matches(ids):
        size = len(items.words[own])
        need = coverage * size - 1e-9
        reach = np.zeros(size + 1, np.int64)
        at = np.unique(i)
        np.add.at(reach, at, 1)
        np.add.at(reach, at + width, -1)
        if (np.cumsum(reach)[:-1] > 0).sum() < need:  # not even with overlaps
            continue
        tiles = tile(i, j, width, size)
        marked = sum(n for _, _, n in tiles)
        if marked < need:
            continue
        if spans is None:
            # Lower case may change the length of a text; then offsets are those in the lower-cased text.
            spans = [m.span() for m in WORD.finditer(text.lower())]
        yield items.keys[own], marked / size, marked, size, [
            {"item_word": a, "words": n, "start": spans[b][0], "end": spans[b + n - 1][1]} for a, b, n in tiles
        ]


def _blocks(tests: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    block, size, points = [], 0, 0
    for row in tests.select(F.col(key).cast("long"), F.col(text)).toLocalIterator():
        words = sum(1 for _ in WORD.finditer(row[1] or ""))
        if block and (size + words > BLOCK_WORDS or points + len(row[1] or "") > BLOCK_POINTS):
            yield block
            block, size, points = [], 0, 0
        block.append((row[0], row[1]))
        size += words
        points += len(row[1] or "")
    if block:
        yield block


def benchmark_overlaps(
    docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", test_key: str = "item_id", test_text: str = "text",
    min_match: int = 5, coverage: float = 0.8,
) -> DataFrame:
    """Pairs of a document and a test item of whose words at least ``coverage`` are tiled.

    Columns ``key``, ``test_key``, ``coverage``, ``matched_words``, ``item_words`` and ``tiles`` (word in the
    item, number of words, code-point offsets in the document).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    result = spark.createDataFrame([], PAIRS)
    for block in _blocks(tests, test_key, test_text):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, min_match)
            for batch in batches:
                found = []
                for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found += [(k, *pair) for pair in contaminated_pairs(items, value.as_py() or "", coverage)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), PAIRS_ARROW)], schema=PAIRS_ARROW)

        result = result.unionByName(rows.mapInArrow(search, PAIRS))
    return result.withColumnsRenamed({"k": key, "item": test_key})


def without_contaminated(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text covers a test item enough.

    The verdict falls where the row is read, so no text is shuffled. Rows without a key are judged like others.
    """
    spark = docs.sparkSession
    min_match, coverage = options.get("min_match", 5), options.get("coverage", 0.8)
    for block in _blocks(tests, options.get("test_key", "item_id"), options.get("test_text", "text")):
        clean = _clean(spark.sparkContext.broadcast(block), min_match, coverage)
        docs = docs.where(F.arrow_udf(clean, "boolean")(F.col(text)))
    return docs


def _clean(shared, min_match: int, coverage: float):
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(shared.value, min_match)
        for batch in batches:
            yield pa.array([next(contaminated_pairs(items, v.as_py() or "", coverage), None) is None for v in batch], pa.bool_())

    clean.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return clean
