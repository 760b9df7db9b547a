"""Licences in texts, by a positional index on the rarest words of licence notices.

A template is a notice without variable parts: its words, its label and the key phrases without
which it does not count. Base phrases are templates that must stand as they are. How rare a
template's word is, is counted: one pass over all texts gives the document frequency of each word
of the templates, and its IDF. For a template of ``n`` words of which ``need`` must be in place, the
index holds the positions of its ``n - need + 2`` words of highest IDF: wherever ``need`` words are
in place, at least two of these are.

A second pass looks up the licence words of highest IDF that a file holds in the index; the
postings are intersected by relative position (place in the file less place in the template), and
where at least two agree the whole template is laid against the file: ``need`` words must be in
place (``SHARE`` of them; all for base phrases), and all words of the key phrases. A file's score is
the largest share of a template's IDF that is in place, 1 where a base phrase stands.

The index is made of the stated templates, so what is broadcast does not grow with the texts, and
both passes are without a shuffle but for one number per word of the templates.

Defined results: a null text is the empty one; a text without licences has no labels (empty
strings), null places and score 0; a notice cut off by either end of a text counts if enough of it
is there; texts are read whole, a portion at a time; rows that repeat give the same row again; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import word_portions

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices of public licences without their variable parts, label and key phrases of each.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", ["free of charge", "associated documentation files"]),
    ("licensed under the apache license version 2 0", "apache-2.0", ["apache license version 2"]),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache", ["in compliance with the license"]),
    ("licensed under the gnu general public license version 3", "gpl-3.0", ["gnu general public license version 3"]),
    ("licensed under the gnu general public license version 2", "gpl-2.0", ["gnu general public license version 2"]),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", ["free software", "gnu general public license"]),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", ["lesser general public license"]),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", ["source and binary forms", "conditions are met"]),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", ["with or without fee"]),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", ["mozilla public license"]),
    ("this is free and unencumbered software released into the public domain", "unlicense", ["free and unencumbered", "public domain"]),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", ["creative commons attribution"]),
    ("licensed under cc by nc 4 0", "cc-by-nc", ["cc by nc"]),
    ("licensed under cc by sa 4 0", "cc-by-sa", ["cc by sa"]),
    ("all rights reserved", "all-rights-reserved", ["all rights reserved"]),
]

#: Share of a notice's words that must be in place, as a fraction of whole numbers.
SHARE = (4, 5)


@dataclass
class Template:
    words: list[bytes]
    label: str
    keys: set[int]  # places of the words of the key phrases
    need: int
    base: bool


def templates(base: dict[str, str] = BASE, notices: list[tuple[str, str, list[str]]] = NOTICES, share: tuple[int, int] = SHARE) -> list[Template]:
    """Base phrases first, then notices."""
    out = []
    for phrase, label in base.items():
        words = phrase.encode().split()
        out.append(Template(words, label, set(range(len(words))), len(words), True))
    for notice, label, phrases in notices:
        words, keys = notice.encode().split(), set()
        for phrase in phrases:
            own = phrase.encode().split()
            at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
            keys.update(range(at, at + len(own)))
        out.append(Template(words, label, keys, -(-len(words) * share[0] // share[1]), False))
    return out


class Index:
    """Postings of the rarest words of the templates: word to (template, place)."""

    def __init__(self, stated: list[Template], frequency: dict[bytes, int], n_docs: int):
        self.templates = stated
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for one in stated for w in one.words}
        self.weights = [sum(self.idf[w] for w in one.words) for one in stated]
        self.longest = max(len(one.words) for one in stated)
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for number, one in enumerate(stated):
            rarest = sorted(range(len(one.words)), key=lambda i: (-self.idf[one.words[i]], i))
            for place in rarest[: len(one.words) - one.need + 2]:
                self.postings.setdefault(one.words[place], []).append((number, place))

    def votes(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Templates and relative positions at which two of the rarest words or more agree."""
        rare = self.postings.keys() & set(words)
        if not rare:
            return
        tally: Counter = Counter()
        for at, word in enumerate(words):
            if word in rare:
                tally.update((number, at - place) for number, place in self.postings[word])
        for found, n in tally.items():
            if n >= min(2, len(self.templates[found[0]].words)):
                yield found

    def verified(self, words: list[bytes], number: int, start: int) -> float | None:
        """The share of the template's IDF in place if it is laid at ``start``; None if it does not count."""
        one = self.templates[number]
        there = [i for i, w in enumerate(one.words) if 0 <= start + i < len(words) and words[start + i] == w]
        if len(there) < one.need or not one.keys.issubset(there):
            return None
        return sum(self.idf[one.words[i]] for i in there) / self.weights[number] if self.weights[number] else 1.0

    def scan(self, text: bytes) -> tuple:
        """Words, places of base phrases, first and last of them, labels of both kinds and the score of a text."""
        held, before, total = [], 0, 0
        places, base, labels, score = [], set(), set(), 0.0
        portions = word_portions(text)
        portion = next(portions, None)
        while portion is not None:
            following = next(portions, None)
            # The end of the portion before stands in front: notices that end in this one are whole.
            words, first = held + portion, total - len(held)
            total += len(portion)
            for number, start in self.votes(words):
                one, end = self.templates[number], first + start + len(self.templates[number].words)
                if end <= before or (end > total and following is not None):
                    continue
                found = self.verified(words, number, start)
                if found is None:
                    continue
                if one.base:
                    places.append(first + start)
                    base.add(one.label)
                labels.add(one.label)
                score = max(score, 1.0 if one.base else found)
            held, before, portion = words[-(self.longest - 1) :], total, following
        least, most = (min(places), max(places)) if places else (None, None)
        return total, len(places), least, most, ",".join(sorted(base)), ",".join(sorted(labels)), round(min(score, 1.0), 6)


def licence_frequencies(docs: DataFrame, stated: list[Template], text: str) -> tuple[dict[bytes, int], int]:
    """In how many rows each word of the templates stands, and the number of rows: a number per word of the templates."""
    vocabulary = sorted({w for one in stated for w in one.words})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = set(vocabulary), Counter()
        for batch in batches:
            for body in batch.column(0):
                own: set[bytes] = set()
                for words in word_portions(body.as_py() or b""):
                    own |= wanted.intersection(words)
                found.update(own)
            found[b""] += batch.num_rows
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text).cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {bytes(r["word"]): r["n"] for r in counted.collect()}
    return frequency, frequency.pop(b"", 0)


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", stated: list[Template] | None = None) -> DataFrame:
    """``key``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score`` of every row."""
    stated = templates() if stated is None else stated
    index = Index(stated, *licence_frequencies(docs, stated, text))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = [index.scan(body.as_py() or b"") for body in batch.column(1)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]], ["k", *[part.split()[0] for part in RESULT.split(", ")]])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(scan, "k long, " + RESULT).withColumnRenamed("k", key)


def _template_rows() -> str:
    rows = []
    for number, one in enumerate(templates()):
        rows += [f"({number}, {place}, '{word.decode()}', {int(place in one.keys)})" for place, word in enumerate(one.words)]
    return ", ".join(rows)


ORACLE_SQL = rf"""
with t(number, place, word, is_key) as (values {_template_rows()}),
stated(number, label, need, is_base) as (values {", ".join(f"({i}, '{one.label}', {one.need}, {str(one.base).lower()})" for i, one in enumerate(templates()))}),
lists as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') l from documents
), words as (
  select doc_id, unnest(l) word, unnest(generate_series(0, len(l) - 1)) pos from lists
), licence as (
  select * from words where word in (select word from t)
), idf as (
  select word, ln(((select count(*) from documents) + 1)::double / (count(distinct doc_id) + 1)::double) w
  from (select distinct word from t) v left join licence using (word) group by word
), whole as (
  select number, sum(w) total, sum(is_key) n_keys from t join idf using (word) group by number
), laid as (
  select doc_id, number, pos - place start, count(*) n, sum(w) s, sum(is_key) keys from licence join t using (word) join idf using (word) group by all
), good as (
  select doc_id, number, start, label, is_base, case when is_base then 1.0 else least(s / total, 1.0) end share
  from laid join stated using (number) join whole using (number) where n >= need and keys = n_keys
), per_doc as (
  select doc_id, count(*) filter (where is_base) n_base, min(start) filter (where is_base) first_word, max(start) filter (where is_base) last_word,
         coalesce(string_agg(distinct label, ',' order by label) filter (where is_base), '') base_labels, string_agg(distinct label, ',' order by label) labels, max(share) score
  from good group by doc_id
)
select doc_id, len(l)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
       coalesce(base_labels, '') base_labels, coalesce(labels, '') as labels, round(coalesce(score, 0), 6)::double score
from lists left join per_doc using (doc_id)
"""
