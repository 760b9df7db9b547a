"""Removal of passages that already stand in an earlier document.

The unit is a paragraph that does not depend on line breaks. A text is read as words: runs without
ASCII blanks, cut after ``WORD_POINTS`` code points; a character of a script that sets no blanks is
a word of its own. A word's rank is the MD5 digest of its normal form (lower case). Of every
``spread`` neighbouring words the one of least rank opens a unit of ``min_words`` words, and so do
the first word of a text and the one from which ``min_words`` are left. Two copies of a passage
open the same units, however the text around them differs and wherever its lines break; a passage
of ``spread + min_words - 1`` words or more (50 by default) always holds one, and no text without a
repeated run of ``min_words`` words is touched.

Units are compared by the MD5 digest of the digests of their words (64 bits each). Digests are grouped over the whole corpus: the
group's smallest (key, text digest, place) keeps its unit, the words of every other occurrence are
removed together with the blanks before them, inside one document too (there, what the first
occurrence covers itself stays). What stays of a text keeps its order; what goes is reported by its
code-point offsets in the original text. Units overlap, so a passage goes from its first to its
last unit: fewer than ``spread`` words may stay at either end of it.

A passage that a third of all documents share costs one partial minimum per task, and the join that
marks its occurrences takes both sides fresh from storage, so that it can be split.

Defined results: a null text is the empty one and stays null; texts of fewer than ``min_words``
words stay as they are; rows that agree in key and text are the same document and get the same
result; rows without a key rank first; a text is read whole, however long, and its units travel in
pieces of at most ``FLUSH``; an empty table gives no rows. Other columns of the input pass through
``remove_repeats``, whatever their names, except the three result columns, which replace columns of
the same names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

#: Words of a unit, and neighbouring words of which one opens a unit.
MIN_WORDS, SPREAD = 31, 20
#: Code points after which a run without blanks is cut.
WORD_POINTS = 32
#: Units sent to the JVM at a time, and words a worker remembers.
FLUSH, HELD = 50_000, 300_000

BLANKS = " \t\n\v\f\r"
#: Scripts that set no blanks between words: Thai to Lao, Burmese, Khmer, kana, Han.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_ALONE = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
#: A word with the blanks before it; the pieces of a text follow each other without a gap.
PIECE = re.compile(f"[{BLANKS}]*(?:[{_ALONE}]|[^{BLANKS}{_ALONE}]{{1,{WORD_POINTS}}})")

UNITS = pa.schema([("k", pa.int64()), ("tk", pa.int64()), ("pos", pa.list_(pa.int32())), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])
UNITS_DDL = "k long, tk long, pos array<int>, high array<long>, low array<long>"
SPANS = "array<struct<start:bigint,end:bigint>>"


class Words(dict):
    """Numbers of words by their pieces, with the beginnings of their digests; remembers those it has met."""

    def __init__(self) -> None:
        super().__init__()
        self.codes = np.zeros(1024, np.uint64)

    def __missing__(self, piece: str) -> int:
        number = len(self)
        if number == len(self.codes):
            self.codes = np.concatenate((self.codes, np.zeros_like(self.codes)))
        norm = piece.lstrip(BLANKS).lower()
        self.codes[number] = int.from_bytes(hashlib.md5(norm.encode(), usedforsecurity=False).digest()[:8], "big")
        self[piece] = number
        return number

    def read(self, text: str) -> np.ndarray:
        """The first 64 bits of the digest of each word."""
        if len(self) > HELD:
            self.clear()
        pieces = PIECE.findall(text)
        numbers = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        return self.codes[numbers]


def unit_starts(codes: np.ndarray, min_words: int, spread: int) -> np.ndarray:
    """Places of the words that open a unit, in order."""
    n = len(codes)
    if n < min_words:
        return np.zeros(0, np.int64)
    edges = np.array([0, n - min_words])
    if n < spread:
        return np.unique(edges)
    # The first of equal ranks opens the unit: rank (32 bits) and place as one number.
    ranked = ((codes >> np.uint64(32)) << np.uint64(31)).astype(np.int64) + np.arange(n)
    least = np.lib.stride_tricks.sliding_window_view(ranked, spread).min(axis=1) & ((1 << 31) - 1)
    starts = np.unique(np.concatenate((least, edges)))
    return starts[starts + min_words <= n]


def _units(docs: DataFrame, key: str, text: str, min_words: int, spread: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Words()
        for batch in batches:
            rows, held = [], 0
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = value.as_py() or ""
                tk = xxhash.xxh64_intdigest(body.encode(), 42)
                tk -= (tk >> 63) << 64
                codes = reader.read(body)
                starts = unit_starts(codes, min_words, spread)
                for at in range(0, len(starts), FLUSH):
                    part = starts[at : at + FLUSH].tolist()
                    digests = b"".join([hashlib.md5(codes[p : p + min_words], usedforsecurity=False).digest() for p in part])
                    halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
                    rows.append((k, tk, part, halves[:, 0], halves[:, 1]))
                    held += len(part)
                    if held >= FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), UNITS)], schema=UNITS)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), UNITS)], schema=UNITS)

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(cut, UNITS_DDL)


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, spread: int = SPREAD) -> DataFrame:
    """``k``, ``tk`` (digest of the text) and ``ranges`` (words to remove, from and to), one row per document that has any."""
    packed = staged(_units(docs, key, text, min_words, spread), "units")
    units = packed.select("k", "tk", F.explode(F.arrays_zip("pos", "high", "low")).alias("u")).select("k", "tk", "u.*")
    first = units.groupBy("high", "low").agg(F.min(F.struct("k", "tk", "pos")).alias("first"), F.count("*").alias("n"))
    first = staged(first.where("n > 1").select("high", "low", "first"), "first-units")
    later = units.join(first, ["high", "low"]).where("not (struct(k, tk, pos) <=> first)")
    same = F.col("k").eqNullSafe(F.col("first.k")) & (F.col("tk") == F.col("first.tk"))
    start = F.when(same, F.greatest(F.col("pos"), F.col("first.pos") + min_words)).otherwise(F.col("pos"))
    # Rows that repeat a whole document give the same ranges again.
    later = later.select("k", "tk", start.alias("from"), (F.col("pos") + min_words).alias("to")).where("from < to").distinct()
    return later.groupBy("k", "tk").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("ranges"))


def cut_text(text: str, ranges: list[tuple[int, int]]) -> tuple[str, list[dict]]:
    """``text`` without the words of ``ranges`` (sorted), and the offsets of what went."""
    ends = np.cumsum(np.fromiter(map(len, PIECE.findall(text)), np.int64))
    spans: list[dict] = []
    for a, b in ranges:
        start, end = int(ends[a - 1]) if a else 0, int(ends[b - 1])
        if spans and start <= spans[-1]["end"]:
            spans[-1]["end"] = max(end, spans[-1]["end"])
        else:
            spans.append({"start": start, "end": end})
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : span["start"]])
        at = span["end"]
    return "".join([*kept, text[at:]]), spans


_CUT = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts, ranges):
        gone = gone.as_py()
        body, spans = cut_text(text.as_py(), [(r["from"], r["to"]) for r in gone]) if gone else (text.as_py(), [])
        out.append({"text": body, "spans": spans})
    return pa.array(out, _CUT)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, spread: int = SPREAD) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``, and what was cut.

    Added columns: ``n_removed`` (passages), ``removed_chars`` (code points) and ``removed_spans``
    (start and end of each removed passage in the original text).
    """
    result = ["n_removed", "removed_chars", "removed_spans"]
    kept = [c for c in docs.columns if c not in result]
    ranges = repeated_ranges(docs, key, text, min_words, spread).withColumnsRenamed({"k": "_cut_k", "tk": "_cut_tk", "ranges": "_cut_ranges"})
    body = F.coalesce(F.col(text), F.lit(""))
    left = docs.select(*kept).withColumn("_cut_key", F.col(key).cast("long")).withColumn("_cut_digest", F.xxhash64(body))
    joined = left.join(ranges, (F.col("_cut_digest") == F.col("_cut_tk")) & F.col("_cut_key").eqNullSafe(F.col("_cut_k")), "left")
    cut = F.arrow_udf(_cut, f"struct<text:string,spans:{SPANS}>")(F.col(text), F.col("_cut_ranges"))
    done = joined.withColumn("_cut_done", cut)
    return done.select(
        *[F.col("_cut_done.text").alias(text) if c == text else F.col(c) for c in kept],
        F.size("_cut_done.spans").alias("n_removed"),
        F.aggregate("_cut_done.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_chars"),
        F.col("_cut_done.spans").alias("removed_spans"),
    )


_SQL_ALONE = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in UNSPACED)
_SQL_BLANKS = " \\t\\n\\v\\f\\r"
ORACLE_SQL = f"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[{_SQL_BLANKS}]*(?:[{_SQL_ALONE}]|[^{_SQL_BLANKS}{_SQL_ALONE}]{{1,{WORD_POINTS}}})') pieces from documents
), pieces as (
  select doc_id, len(pieces) n, unnest(pieces) piece, unnest(generate_series(0, len(pieces) - 1)) pos from split
), words as (
  select *, lower(regexp_replace(piece, '^[{_SQL_BLANKS}]+', '')) word,
         coalesce(sum(length(piece)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) s from pieces
), least as (
  select doc_id, pos, n, min(substr(md5(word), 1, 8) || lpad(pos::varchar, 10, '0')) over (partition by doc_id order by pos rows between current row and {SPREAD - 1} following) l from words
), starts as (
  select distinct doc_id, pos from (
    select doc_id, n, substr(l, 9)::bigint pos from least where pos + {SPREAD} <= n
    union all select doc_id, n, 0 from least where pos = 0
    union all select doc_id, n, n - {MIN_WORDS} from least where pos = 0) where pos >= 0 and pos + {MIN_WORDS} <= n
), units as (
  select s.doc_id, s.pos, string_agg(w.word, ' ' order by w.pos) body
  from starts s join words w on w.doc_id = s.doc_id and w.pos between s.pos and s.pos + {MIN_WORDS - 1} group by s.doc_id, s.pos
), ranked as (
  select doc_id, pos, row_number() over by_rank place, first_value(doc_id) over by_rank first_doc, first_value(pos) over by_rank first_pos
  from units window by_rank as (partition by body order by doc_id, pos)
), ranges as (
  select doc_id, case when first_doc = doc_id then greatest(pos, first_pos + {MIN_WORDS}) else pos end a, pos + {MIN_WORDS} b from ranked where place > 1
), gone as (
  select distinct w.doc_id, w.pos from words w join ranges r on w.doc_id = r.doc_id and w.pos >= r.a and w.pos < r.b
), marked as (
  select w.doc_id, w.pos, w.piece, w.s, g.pos is not null gone, w.pos - row_number() over (partition by w.doc_id, g.pos is not null order by w.pos) island
  from words w left join gone g on g.doc_id = w.doc_id and g.pos = w.pos
), spans as (
  select doc_id, min(s)::bigint a, max(s + length(piece))::bigint b from marked where gone group by doc_id, island
), cut as (
  select doc_id, count(*)::integer n_removed, sum(b - a)::bigint removed_chars, string_agg(a || '-' || b, ',' order by a) removed from spans group by doc_id
), kept as (
  select doc_id, coalesce(string_agg(piece, '' order by pos) filter (where not gone), '') body from marked group by doc_id
)
select d.doc_id, case when c.doc_id is null then d.text else k.body || regexp_extract(d.text, '[{_SQL_BLANKS}]*$') end as text,
       coalesce(c.n_removed, 0)::integer as n_removed, coalesce(c.removed_chars, 0)::bigint as removed_chars, coalesce(c.removed, '') as removed
from documents d left join cut c using (doc_id) left join kept k using (doc_id)
"""
