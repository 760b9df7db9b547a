"""The best documents of each query by a stated integer score, found by the Best Position Algorithm.

Terms are runs of ASCII letters (lower-cased), digits and code points from U+0080 on. One pass over
the texts keeps, per document, its length and the counts of the terms that any query holds; numbers
of documents and terms, and the document frequencies of the queries' terms, are counted from that
table. Then every task cuts its documents into shards of at most ``POSTINGS`` postings, makes an
impact list (documents by descending score) for each term and answers every query:

- *sorted access*: the next positions of all the query's lists are read, in portions that double;
- *direct access*: each document met is looked up in all the lists, which gives its whole score
  and marks its position in every list as seen;
- *best position* of a list: the end of its beginning that has been seen without a gap, by either
  access. A document not yet met can score at most the sum of the impacts that follow the best
  positions. The search stops once that sum is strictly below the shard's k-th score, so that
  documents with equal scores are all met.

A shard's best ``k`` per query go on; a window whose limit Spark applies before the shuffle ranks
them. No task sees more of a list than its shard, however frequent the term. Queries are the stated
query set: their terms are broadcast in blocks of at most ``BLOCK_TERMS`` and each block is one job.

Defined results: a null text has no terms; queries without terms, or whose terms no document
holds, get no rows; rows that repeat a query id are one query with the terms of all, those without
an id too (its id stays null); every row of the documents is a document of its own, so repeated
rows are ranked one after another; a document without a key comes first among equal scores; texts
are read whole, a portion at a time; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import staged, word_portions

#: Postings of a shard, terms of the queries in a block, and positions read first.
POSTINGS, BLOCK_TERMS, FIRST = 1_500_000, 500_000, 16
#: Stands for a missing key, which comes first among equal scores.
NO_KEY = -(1 << 63)

COUNTS = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])


def term_counts(text: bytes) -> Counter:
    found: Counter = Counter()
    for words in word_portions(text):
        found.update(words)
    return found


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``item`` and its distinct terms, one row each."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column(0), batch.column(1)):
                terms = list(term_counts(body.as_py() or b""))
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.binary())], ["item", "term"])

    rows = queries.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(split, "item long, term binary").distinct()


def counted(docs: DataFrame, numbers: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``k``, ``n`` (terms with repeats) and the counts of the numbered terms of every document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            rows = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = term_counts(body.as_py() or b"")
                if found:
                    known = sorted((numbers[t], found[t]) for t in found.keys() & numbers.keys())
                    rows.append((k, found.total(), [t for t, _ in known], [c for _, c in known]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), COUNTS)], schema=COUNTS)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(count, "k long, n long, terms array<int>, tfs array<long>")


class ImpactList:
    """Postings of one term in a shard: by document for direct access, by impact for sorted access."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        self.docs, self.impacts = docs, impacts
        self.order = np.argsort(-impacts, kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(docs))


def best_documents(lists: list[ImpactList], size: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents met with their whole scores, among them all of the best ``k`` and their equals; and how many positions were read.

    ``lists`` hold impacts above zero; ``size`` is the number of documents of the shard.
    """
    met, docs, scores = np.zeros(size, bool), [], []
    seen = [np.zeros(len(one.docs), bool) for one in lists]
    best = [0] * len(lists)
    at, portion, held = 0, FIRST, 0
    while any(b < len(one.docs) for b, one in zip(best, lists)):
        read = []
        for one, own in zip(lists, seen):
            read.append(one.docs[one.order[at : at + portion]])
            own[at : at + portion] = True
        found = np.unique(np.concatenate(read))
        found = found[~met[found]]
        met[found] = True
        score = np.zeros(len(found), np.int64)
        for one, own in zip(lists, seen):
            place = np.minimum(np.searchsorted(one.docs, found), len(one.docs) - 1)
            hit = one.docs[place] == found
            score[hit] += one.impacts[place[hit]]
            own[one.place[place[hit]]] = True
        docs.append(found)
        scores.append(score)
        held += len(found)
        bound = 0
        for i, (one, own) in enumerate(zip(lists, seen)):
            gap = int(np.argmin(own[best[i] :])) if best[i] < len(own) else 0
            best[i] = len(own) if best[i] < len(own) and own[best[i] + gap] else best[i] + gap
            if best[i] < len(own):
                bound += int(one.impacts[one.order[best[i]]])
        at, portion = at + portion, 2 * portion
        if held >= k:
            every = np.concatenate(scores)
            if bound < np.partition(every, held - k)[held - k]:
                break
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), at
    return np.concatenate(docs), np.concatenate(scores), at


def _answers(rows: list[pa.RecordBatch], queries: list[tuple[int | None, list[int]]], weights: dict[int, int], n_docs: int, n_terms: int, k: int) -> pa.RecordBatch:
    """The best ``k`` documents of every query among the documents of a shard."""
    batch = pa.Table.from_batches(rows).combine_chunks()
    keys = batch.column("k").to_pylist()
    keys = np.array([NO_KEY if v is None else v for v in keys], np.int64)
    lengths = batch.column("n").to_numpy()
    terms, tfs = batch.column("terms").combine_chunks(), batch.column("tfs").combine_chunks()
    sizes = np.diff(terms.offsets.to_numpy())
    docs, term, tf = np.repeat(np.arange(len(keys)), sizes), terms.flatten().to_numpy(), tfs.flatten().to_numpy()
    norm = 50 + (50 * lengths * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * norm[docs])
    order = np.argsort(term, kind="stable")
    docs, impact, term = docs[order], impact[order], term[order]
    lists: dict[int, ImpactList | None] = {}

    def impacts(number: int) -> ImpactList | None:
        if number not in lists:
            low, high = np.searchsorted(term, [number, number + 1])
            own = impact[low:high] * weights.get(number, 0)
            lists[number] = ImpactList(docs[low:high][own > 0], own[own > 0]) if (own > 0).any() else None
        return lists[number]

    items, found, scores = [], [], []
    for item, numbers in queries:
        used = [one for one in map(impacts, numbers) if one is not None]
        if not used:
            continue
        own, score, _ = best_documents(used, len(keys), k)
        top = np.lexsort((keys[own], -score))[:k]
        items += [item] * len(top)
        found.append(keys[own[top]])
        scores.append(score[top])
    found = np.concatenate(found) if found else np.zeros(0, np.int64)
    scores = np.concatenate(scores) if scores else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(found, mask=found == NO_KEY), pa.array(scores)], ["item", "k", "score"])


def _block(docs: DataFrame, queries: list[tuple[int | None, list[bytes]]], key: str, text: str, k: int) -> DataFrame:
    """The best documents of a block of queries, some of which later documents of other shards displace."""
    vocabulary = sorted({t for _, terms in queries for t in terms})
    numbers = {t: i for i, t in enumerate(vocabulary)}
    counts = staged(counted(docs, numbers, key, text), "term-counts")
    n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
    # One number per term of the block: bounded like the block.
    frequency = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    weights = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in frequency}
    numbered = [(item, sorted(numbers[t] for t in terms)) for item, terms in queries]
    shared = docs.sparkSession.sparkContext.broadcast((numbered, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
            low, base = 0, 0
            while low < len(ends):
                high = max(low + 1, int(np.searchsorted(ends, base + POSTINGS - held, "right")))
                rows.append(batch.slice(low, high - low))
                held += int(ends[high - 1]) - base
                low, base = high, int(ends[high - 1])
                if held >= POSTINGS:
                    yield _answers(rows, *shared.value, n_docs, n_terms, k)
                    rows, held = [], 0
        if rows:
            yield _answers(rows, *shared.value, n_docs, n_terms, k)

    return counts.mapInArrow(search, "item long, k long, score long")


def rank_documents(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", k: int = 50) -> DataFrame:
    """``query_key``, ``rank``, ``key`` and ``score`` of the best ``k`` documents of each query, equal scores by ascending key."""
    spark = docs.sparkSession
    terms = staged(query_terms(queries, query_key, query_text), "query-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    best = None
    for number in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        # The stated query set, a block of bounded size at a time.
        rows = [(r["item"], [bytes(t) for t in r["terms"]]) for r in own.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0]))
        part = _block(docs, rows, key, text, k)
        best = part if best is None else best.unionByName(part)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("k"))))
    return ranked.where(F.col("rank") <= k).select(F.col("item").alias(query_key), "rank", F.col("k").alias(key), "score")


ORACLE_SQL = r"""
with counted as (
  select doc_id, rowid, term, count(*) tf from (
    select doc_id, rowid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
    from (select *, row_number() over () rowid from documents)) group by all
), lengths as (
  select rowid, sum(tf)::bigint n from counted group by rowid
), totals as (
  select count(*)::bigint nd, sum(n)::bigint nt from lengths
), wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark
), weights as (
  select term, floor(1000 * ln((2 * max(nd) + 2)::double / (2 * count(*) + 1)::double))::bigint w from counted, totals where term in (select term from wanted) group by term
), scored as (
  select item_id, doc_id, c.rowid, sum(w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * l.n * nd) // nt))))::bigint score
  from wanted join counted c using (term) join weights using (term) join lengths l on l.rowid = c.rowid, totals group by item_id, doc_id, c.rowid
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0
)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 50
"""
