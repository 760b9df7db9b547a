"""Groups of spelling variants: words one edit apart, found by composing acceptors.

Words are maximal runs of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased, of at least
``min_points`` code points, that occur at least ``min_count`` times in the corpus; occurrences are
counted per task before they are shuffled. Two words are near if one inserted, deleted or replaced
code point turns one into the other.

Near pairs are the accepting paths of the composition of the vocabulary's minimised acceptor with
the transducer that makes exactly one edit and the acceptor again. The composition is enumerated
per initial state: an edit lies at one place, the end of the common beginning of both words, so the
places of a word are cut into zones, and words that agree before and behind a zone (for the length
of the shorter word of a pair) start from one state of the acceptor and end in one of its mirror
image. Such a partition builds the minimised acceptor of what its words hold in the zone and walks
the composition from there; a pair is found in the one zone its edit lies in. A partition of more
than ``LARGEST`` words is cut again into partitions of narrower zones; a zone of one place can
hold no more words than there are pairs of letters, so no task ever gets an unbounded partition, and
the acceptor of the whole vocabulary is never in one place. Pairs themselves are not sent: each
partition reports, for each word, the number of its near words and the most frequent of them.

The form of a word is its near word of largest count (equal counts: the first in code-point order)
if that is at least ``ratio`` times the word's own; roots follow forms by pointer doubling, and
counts grow along a chain, so it ends.

Defined results: a null text has no words; a null key is written as the empty string where
occurrences are damaged; rows that repeat count again; texts are read whole and words compared
whole, however long (what lies outside a zone is compared by digest); an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

#: Words a partition of the composition may hold before it is cut, and places of a first zone.
LARGEST, ZONE = 20_000, 24
#: Distinct words a task counts before it sends them on.
HELD = 200_000
ROWS = pa.schema([("part", pa.binary()), ("low", pa.int32()), ("width", pa.int32()), ("tail", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("longer", pa.bool_()), ("middle", pa.string())])
ROWS_DDL = "part binary, low int, width int, tail int, word binary, n long, longer boolean, middle string"


def lowered(text: str) -> str:
    """A-Z as a-z, all others as they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def damaged(key: str, run: str, every: int) -> str:
    """The run, without one code point where the checksum of key and run says so."""
    code = zlib.crc32(f"{key}:{run}".encode())
    if code % every:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str, text: str, min_points: int, min_count: int, every: int | None) -> DataFrame:
    """``word`` and ``n`` of the words of the corpus; ``every`` damages occurrences (None: none)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shorter runs are no words, damaged or not.
        run_of, found = re.compile(f"[a-z\u00c0-\u00ff]{{{min_points},}}"), Counter()
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = Counter(run_of.findall(lowered(body.as_py() or "")))
                for run, n in runs.items():
                    word = run if every is None else damaged(k, run, every)
                    if len(word) >= min_points:
                        found[word] += n
                if len(found) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
                    found.clear()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def zones(places: int) -> list[tuple[int, int]]:
    """The places cut into at least two zones of at most ``ZONE``, as even as can be."""
    number = max(2, -(-places // ZONE))
    edges = [places * i // number for i in range(number + 1)]
    return list(zip(edges, edges[1:]))


def part_name(*parts) -> bytes:
    # A short digest of what the words of a partition agree in; 128 bits tell any partitions apart.
    return hashlib.md5(b"|".join(p if isinstance(p, bytes) else str(p).encode() for p in parts), usedforsecurity=False).digest()


def rows_of(word: str, n: int, min_points: int) -> Iterator[tuple]:
    """The partitions a word belongs to: as the shorter word of a pair, and as the longer."""
    name = hashlib.md5(word.encode(), usedforsecurity=False).digest()
    for shorter in (len(word), len(word) - 1):
        if shorter < min_points:
            continue
        before, last = hashlib.md5(usedforsecurity=False), 0
        cuts = zones(shorter + 1)
        # Digests of the endings that stand behind each zone, from the right.
        behind, tails, end = hashlib.md5(usedforsecurity=False), {}, len(word)
        for low, high in reversed(cuts):
            tail = max(shorter - high, 0)
            behind.update(word[len(word) - tail : end].encode()[::-1])
            end = len(word) - tail
            tails[low] = (tail, behind.digest())
        for low, high in cuts:
            before.update(word[last:low].encode())
            last = low
            tail, digest = tails[low]
            yield part_name(shorter, low, high, before.digest(), digest), low, high - low, tail, name, n, len(word) > shorter, word[low : len(word) - tail]


def _spread(words: DataFrame, min_points: int) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in rows_of(word, n, min_points):
                    rows.append(row)
                    if len(rows) >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROWS)], schema=ROWS)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROWS)], schema=ROWS)

    return words.select("word", "n").mapInArrow(spread, ROWS_DDL)


def halves(part: bytes, low: int, width: int, tail: int, word: bytes, n: int, longer: bool, middle: str) -> list[tuple]:
    """A row in the partitions of the two halves of its zone."""
    half = width // 2
    # What of the middle stands behind the first half, for the length of the shorter word.
    cut = max(len(middle) - longer - half, 0)
    first, behind = middle[: len(middle) - cut], middle[len(middle) - cut :]
    return [
        (part_name(part, "first", behind), low, half, tail + cut, word, n, longer, first),
        (part_name(part, "second", middle[:half]), low + half, width - half, tail, word, n, longer, middle[half:]),
    ]


def _narrower(rows: DataFrame) -> DataFrame:
    """Rows of partitions that are too large, in the two halves of their zones."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [new for row in zip(*[batch.column(name).to_pylist() for name in ROWS.names]) for new in halves(*row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ROWS)], schema=ROWS)

    return rows.mapInArrow(halve, ROWS_DDL)


class Acceptor:
    """Minimised acyclic acceptor of a set of strings: equal right languages are one state."""

    def __init__(self, strings: list[str]):
        self.states: list[tuple[bool, dict[str, int]]] = []
        self.known: dict[tuple, int] = {}
        self.shared: dict[tuple[int, int], list[str]] = {}
        self.start = self._state(sorted(set(strings)), 0)

    def _state(self, strings: list[str], depth: int) -> int:
        """The state that accepts what is left of sorted strings after ``depth`` points they share."""
        final = bool(strings) and len(strings[0]) == depth
        arcs, at = {}, int(final)
        while at < len(strings):
            point, end = strings[at][depth], at
            while end < len(strings) and strings[end][depth] == point:
                end += 1
            arcs[point] = self._state(strings[at:end], depth + 1)
            at = end
        shape = (final, *arcs.items())
        if shape not in self.known:
            self.known[shape] = len(self.states)
            self.states.append((final, arcs))
        return self.known[shape]

    def common(self, a: int, b: int) -> list[str]:
        """What both states accept: the composition after its edit, where it copies."""
        if a > b:
            a, b = b, a
        if (a, b) not in self.shared:
            (final_a, arcs_a), (final_b, arcs_b) = self.states[a], self.states[b]
            found = [""] if final_a and final_b else []
            for point in arcs_a.keys() & arcs_b.keys():
                found += [point + rest for rest in self.common(arcs_a[point], arcs_b[point])]
            self.shared[a, b] = found
        return self.shared[a, b]

    def one_edit(self, places: int) -> Iterator[tuple[str, str]]:
        """Pairs of accepted strings whose first difference is the only edit and lies before ``places``.

        Of equal lengths (a replaced point), or the second one point longer (an inserted one).
        """
        waiting = [(self.start, "")]
        while waiting:
            state, read = waiting.pop()
            if len(read) >= places:
                continue
            arcs = list(self.states[state][1].items())
            for i, (point, after) in enumerate(arcs):
                for other, there in arcs[:i]:
                    for rest in self.common(after, there):
                        yield read + point + rest, read + other + rest
                for rest in self.common(state, after):
                    # The inserted point is the first that differs.
                    if not rest.startswith(point):
                        yield read + rest, read + point + rest
                waiting.append((after, read + point))


def near_counts(shorter: dict[str, int], longer: dict[str, int], places: int) -> dict[tuple[bool, str], list]:
    """For each word of a partition its number of near words there, and of these the most frequent, first in order.

    The dicts hold counts by middle part: of the words of the shorter length, and of one point more.
    Two words of the longer length are a pair of the partition where they are the shorter ones.
    """
    found: dict[tuple[bool, str], list] = {}

    def meet(own: tuple[bool, str], n: int, other: str) -> None:
        entry = found.get(own)
        if entry is None:
            found[own] = [1, n, other]
        else:
            entry[0] += 1
            if n > entry[1] or (n == entry[1] and other < entry[2]):
                entry[1:] = n, other

    for a, b in Acceptor([*shorter, *longer]).one_edit(places):
        if a in shorter:
            to_longer = len(b) > len(a)
            there = longer if to_longer else shorter
            if b in there:
                meet((False, a), there[b], b)
                meet((to_longer, b), shorter[a], a)
    return found


def _links(rows: DataFrame) -> DataFrame:
    """``word`` (digest), ``near``, and count and middle part of the best near word, of every partition that has any."""
    parts = rows.groupBy("part", "low", "width", "tail").agg(F.collect_list(F.struct("word", "n", "longer", "middle")).alias("words"))
    parts = parts.where((F.size("words") > 1) & F.exists("words", lambda w: ~w["longer"])).select("low", "width", "tail", "words")

    def enumerate_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for low, width, tail, words in zip(*[c.to_pylist() for c in batch.columns]):
                names = {(w["longer"], w["middle"]): w["word"] for w in words}
                shorter = {w["middle"]: w["n"] for w in words if not w["longer"]}
                longer = {w["middle"]: w["n"] for w in words if w["longer"]}
                for own, (near, n, other) in near_counts(shorter, longer, width).items():
                    out.append((names[own], near, n, low, tail, other))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["word", "near", "n", "low", "tail", "middle"])

    return parts.mapInArrow(enumerate_pairs, "word binary, near long, n long, low int, tail int, middle string")


def near_words(words: DataFrame, min_points: int) -> DataFrame:
    """``word``, ``n``, ``n_near`` and, where there is any, count and text of the best near word (``best``)."""
    rows, links = staged(_spread(words, min_points), "zones"), None
    while True:
        large = staged(rows.groupBy("part", "width").agg(F.count("*").alias("size")).where((F.col("size") > LARGEST) & (F.col("width") > 1)).select("part"), "large-zones")
        done = large.isEmpty()
        part = _links(rows if done else rows.join(large, "part", "left_anti"))
        links = part if links is None else links.unionByName(part)
        if done:
            break
        rows = staged(_narrower(rows.join(large, "part", "left_semi")), "zones")
    # A word meets at most as many partitions as it has zones.
    best = links.groupBy("word").agg(F.sum("near").alias("n_near"), F.max("n").alias("most"), F.collect_list(F.struct("n", "low", "tail", "middle")).alias("all"))
    named = words.withColumn("_name", F.unhex(F.md5(F.col("word").cast("binary"))))
    joined = named.join(best.withColumnRenamed("word", "_name"), "_name", "left")
    # A near word agrees with the word before and behind the zone.
    spelled = lambda c: F.concat(F.substring(F.col("word"), F.lit(1), c["low"]), c["middle"], F.right(F.col("word"), c["tail"]))
    first = F.array_min(F.transform(F.filter("all", lambda c: c["n"] == F.col("most")), spelled))
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("most"), first.alias("best"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", min_points: int = 6, min_count: int = 5, ratio: int = 5, every: int | None = 199) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word.

    ``every`` drops a code point of the occurrences whose checksum it divides (None: of none).
    """
    words = staged(word_counts(docs, key, text, min_points, min_count, every), "words")
    near = near_words(words, min_points)
    has = F.col("most") >= ratio * F.col("n")
    formed = staged(near.select("word", F.when(has, F.col("best")).alias("form"), "n", "n_near", F.when(has, F.col("most")).alias("form_n")), "forms")
    # Pointer doubling: the way to the root halves with each round.
    way = staged(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        way = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return formed.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
