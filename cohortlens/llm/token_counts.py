"""Token counts of whole texts, without moving a pre-token between machines.

Two tiers answer most look-ups on the map side: a broadcast table with the token lengths of
the pre-tokens that are frequent in the whole corpus, and a cache in each Python worker that
remembers the lengths of those it had to encode itself. Only the (bounded) summaries of the
partitions travel, merged in a tree.

A sentencepiece BPE model is split into pre-tokens only where that cannot change a count: no
piece of the vocabulary may hold a word mark after another character (then no merge crosses a
blank), nor a line feed (then none crosses a line end). A model that breaks the first rule is
encoded text by text; one that breaks the second is split at blanks only.

Defined results: a null text counts like the empty one (0 bytes, 0 tokens); every row gives one
row, repeated rows too; texts of any length are counted whole; an empty table gives no rows.
Columns of the input other than the key and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the broadcast table: the bound on what is sent to every executor (about 2 MB).
FREQUENT = 65_536
#: Entries a partition reports, and entries a worker holds while counting or caching.
REPORTED, HELD = 16_384, 400_000
LONGEST_KEY = 64


class PieceLengths:
    """Token lengths of pre-tokens; those not known yet are encoded and remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        # "a b" and "a" + "b": the model adds one word mark before a text and keeps all blanks.
        separable = [len(x) for x in self.model.encode(["a  b", "a", " b"], num_threads=1)]
        self.by_words = separable[0] == separable[1] + separable[2] and not any(re.search("[^▁]▁", p) for p in plain)
        # A single blank at the end of a text is a pre-token of its own, and no text by itself gives it.
        self.last_blank = len(self.model.encode("a ", num_threads=1)) - len(self.model.encode("a", num_threads=1))
        self.by_lines = self.by_words and not any("\n" in p for p in plain)
        # A plain dict: differences between a set and a subclass of dict walk through all of the dict.
        self.known: dict[str, int] = {}
        self.first: dict[str, int] = {}

    def learn(self, frequent: dict[str, int]) -> None:
        """Start from the broadcast table; what a worker remembers from the same table stays."""
        if self.first is not frequent:
            self.first = frequent
            self.known = dict(frequent)

    def split(self, text: str) -> list[str]:
        """Pre-tokens whose lengths add up to the length of ``text``.

        Each stands for a blank and itself. One that begins with a line feed was not preceded by
        a blank, which ``length_of`` allows for.
        """
        if "▁" in text:
            text = text.replace("▁", " ")
        spaced = "  " in text or " \n" in text or text[:1] in (" ", "\n") or text[-1:] == " "
        if not spaced:
            return (text.replace("\n", " \n") if self.by_lines else text).split(" ")
        # Runs of blanks belong to the word behind them; the first blank is the one that counts as the mark.
        return ["▁" + w for w in re.findall(r" *[^ ]+| +$", " " + text)]

    def encoded(self, keys: list[str]) -> list[int]:
        # "▁" + " word" holds its own blanks; of these the model adds the first itself.
        texts = [k[2:] if k[0] == "▁" else k for k in keys]
        counts = [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [self.last_blank if k == "▁ " else n - (k[0] == "\n") for k, n in zip(keys, counts)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_words:
            return len(self.model.encode(text, num_threads=1))
        words = self.split(text)
        missing = list(set(words).difference(self.known))
        if missing:
            if len(self.known) > HELD:
                self.known = dict(self.first)
                missing = list(set(words).difference(self.known))
            self.known.update(zip(missing, self.encoded(missing)))
        return sum(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def piece_lengths(path: str) -> PieceLengths:
    return PieceLengths(path)


@lru_cache(maxsize=2)
def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _packed(counts: Counter) -> bytes:
    # Ties are cut in key order, so that the table does not depend on the order of rows.
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:REPORTED]
    return zlib.compress(json.dumps(top).encode(), 1)


def _merged(a: bytes, b: bytes) -> bytes:
    counts = Counter(dict(json.loads(zlib.decompress(a))))
    counts.update(dict(json.loads(zlib.decompress(b))))
    return _packed(counts)


def frequent_lengths(docs: DataFrame, text: str, path: str) -> dict[str, int]:
    """Lengths of the pre-tokens that are frequent in all of ``docs``.

    Each partition summarises its texts in bounded memory; the summaries are merged in a tree on
    the executors. The summary decides only what is looked up fast, never a count.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, counts = piece_lengths(path), Counter()
        for batch in batches:
            for value in batch.column(0):
                counts.update(lengths.split(value.as_py() or ""))
                if len(counts) > HELD:
                    counts = Counter(dict(counts.most_common(HELD // 4)))
        for word in [w for w in counts if len(w) > LONGEST_KEY or not w]:
            del counts[word]
        yield pa.RecordBatch.from_arrays([pa.array([_packed(counts)], pa.binary())], ["summary"])

    summaries = docs.select(F.col(text).alias("t")).mapInArrow(summarise, "summary binary").rdd.map(lambda r: bytes(r[0]))
    if summaries.getNumPartitions() == 0:
        return {}
    words = [w for w, _ in json.loads(zlib.decompress(summaries.treeReduce(_merged, depth=3)))][:FREQUENT]
    return dict(zip(words, piece_lengths(path).encoded(words))) if words else {}


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row of ``docs``.

    ``path`` is a sentencepiece ``.model`` or a tokenizers ``.json`` file that lies at the same
    place on every executor. Special strings inside texts are handled as the library does by
    default; nothing is added, cut or padded.
    """
    if path.endswith(".json"):

        def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokenizer = json_tokenizer(path)
            for batch in batches:
                yield pa.array([len(tokenizer.encode(v.as_py() or "", add_special_tokens=False).ids) for v in batch], pa.int64())

    else:
        lengths = piece_lengths(path)
        frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, path) if lengths.by_words else {})

        def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            lengths = piece_lengths(path)
            lengths.learn(frequent.value)
            for batch in batches:
                yield pa.array([lengths.count(v.as_py() or "") for v in batch], pa.int64())

    counted = F.arrow_udf(_typed(counts), "long")
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), F.octet_length(body).cast("long").alias("n_bytes"), counted(body).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def _typed(fn):
    fn.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return fn
