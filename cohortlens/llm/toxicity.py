"""Toxicity of whole texts by a small recurrent network that is trained here, in numpy.

A word enters as three vectors: one of the word itself, and the mean and the largest components
of those of its runs of four and six characters (both from hashed tables). A gated recurrent layer reads a window of words in both
directions, attention pools the states, a logistic unit scores the window. A text is cut into
windows of ``WINDOW`` words that begin every ``STRIDE`` words and overlap; the last one ends with
the text. All windows of a text are scored, its score is the largest, put on a probability scale
fitted on labelled rows that the network did not learn from.

Learning: a bounded sample of labelled rows (``max_rows``, at most a third of them with label 1;
only texts of at most ``max_bytes``) is fetched to the driver, which trains on up to
``windows_per_row`` windows of each text. The probability scale is cross-fitted at every size: the texts
of each label are dealt to ``FOLDS`` folds, each fold is judged by a network that learned from the
others, and one curve is fitted on all these judgements; the network that scores learns from all.
Near copies within the sample count once. The sample is chosen by a hash of the key, so the model
does not depend on the order of rows. Scoring covers every row and whole texts, and a score depends
on its text and the model alone: words and windows enter the sums in blocks of one height.

Defined results: a null text is the empty one; a text without words gets the score of a window
without words; labels other than 0 and 1 and rows without a key teach nothing; a label of a single
text cannot be cross-fitted and leaves the scale as it is; a key with both labels counts as 1, and of rows that repeat a key the smallest text is learned from; without rows
of both labels every score is the share of label 1 (0 if there are none). Every row gives one row,
an empty table none. Other columns of either table are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 48, 32
BUCKETS, WIDTH, HIDDEN = 1 << 15, 8, 8
#: Folds of the labelled rows for the probability scale.
FOLDS = 2
#: Standard errors by which a bucket may differ by chance.
CHANCE = 2.0
#: Step of the optimiser, and its share for the hashed tables, most rows of which are seen a few times.
RATE, TABLE_SHARE = 0.01, 0.2
#: Windows scored at a time, words a worker remembers, words whose vectors are worked out at a time, and words in one product.
BATCH, HELD, CHUNK, BLOCK = 512, 150_000, 20_000, 256
PUNCTUATION = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—_*#/\\|`~"


@dataclass
class Model:
    words: np.ndarray  # BUCKETS x WIDTH
    grams: np.ndarray  # BUCKETS x WIDTH
    inputs: np.ndarray  # 3 WIDTH x 2 directions x 3 HIDDEN
    bias: np.ndarray  # 2 x 1 x 3 HIDDEN
    recur: np.ndarray  # 2 x HIDDEN x 3 HIDDEN
    attend: np.ndarray  # 2 HIDDEN
    out: np.ndarray  # 2 HIDDEN + 1
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    def parameters(self) -> list[np.ndarray]:
        return [self.words, self.grams, self.inputs, self.bias, self.recur, self.attend, self.out]


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word, buckets of all its character grams one after another, and their numbers."""
    parts = [_buckets(words[low : low + CHUNK]) for low in range(0, max(len(words), 1), CHUNK)]
    return tuple(np.concatenate(p) for p in zip(*parts))


def _buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cores = [w.strip(PUNCTUATION) or w for w in words]
    # Each word stands as " word " so that starts and ends make grams of their own.
    points = np.frombuffer((" " + "  ".join(cores) + " " if cores else "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, cores), np.int64, len(cores)) + 2
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    mixed = (points + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    word = (np.add.reduceat(mixed, starts) >> np.uint64(40)) % np.uint64(BUCKETS) if len(points) else np.zeros(0, np.uint64)
    # A word of one letter has one gram, the whole; others grams of four and of six points from every
    # place that leaves room for them. A word's grams of four stand before its grams of six.
    padded = np.concatenate((points, np.zeros(6, np.uint64)))
    counts = np.stack([np.maximum(sizes - 3, 1), np.maximum(sizes - 5, 0)], axis=1)
    number = counts.sum(axis=1)
    runs = counts.ravel()
    offset = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = np.repeat(np.repeat(starts, 2), runs) + offset
    long = np.repeat(np.tile([False, True], len(sizes)), runs)
    gram = np.zeros(len(begin), np.uint64)
    for j in range(6):
        more = gram * np.uint64(0x100000001B3) + padded[begin + j] + np.uint64(1)
        gram = more if j < 4 else np.where(long, more, gram)
    gram ^= gram >> np.uint64(31)
    gram = (gram * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)
    return word.astype(np.int64), (gram % np.uint64(BUCKETS)).astype(np.int64), number


def _features(model: Model, buckets) -> np.ndarray:
    word, grams, number = buckets
    if not len(word):
        return np.zeros((0, 3 * WIDTH), np.float32)
    found, first = model.grams[grams], np.concatenate(([0], np.cumsum(number)[:-1]))
    mean = np.add.reduceat(found, first, axis=0) / number[:, None].astype(np.float32)
    return np.concatenate([model.words[word], mean, np.maximum.reduceat(found, first, axis=0)], axis=1).astype(np.float32)


def _projected(model: Model, features: np.ndarray) -> np.ndarray:
    """Inputs to the gates of both directions for each word: words x 2 x 3 HIDDEN."""
    return np.tensordot(features, model.inputs, 1) + model.bias[:, 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(model: Model, gates_in: np.ndarray, mask: np.ndarray | None, keep: list | None = None):
    """States (steps x 2 x windows x HIDDEN) for inputs steps x 2 x windows x 3 HIDDEN.

    The second direction gets its steps in reverse. ``mask`` (steps x 2 x windows x 1) is zero where
    a window has no word; the state then stays as it is.
    """
    steps, _, n, _ = gates_in.shape
    state = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((steps, 2, n, HIDDEN), np.float32)
    for t in range(steps):
        turned = state @ model.recur
        gates = _sigmoid(gates_in[t, ..., : 2 * HIDDEN] + turned[..., : 2 * HIDDEN])
        update, reset = gates[..., :HIDDEN], gates[..., HIDDEN:]
        fresh = 2 * _sigmoid(2 * (gates_in[t, ..., 2 * HIDDEN :] + reset * turned[..., 2 * HIDDEN :])) - 1
        step = (1 - update) * (fresh - state)
        if mask is not None:
            step *= mask[t]
        if keep is not None:
            keep.append((state, update, reset, fresh, turned[..., 2 * HIDDEN :]))
        state = state + step
        states[t] = state
    return states


def _pool(model: Model, states: np.ndarray, mask: np.ndarray | None):
    """Window logits, pooled states and attention weights (steps x windows)."""
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
    level = both @ model.attend
    if mask is not None:
        level = np.where(mask[:, 0, :, 0] > 0, level, -1e9)
    weight = np.exp(level - level.max(axis=0))
    if mask is not None:
        weight *= mask[:, 0, :, 0]
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weight, both)
    return pooled @ model.out[:-1] + model.out[-1], pooled, weight, both


def window_starts(n: int) -> list[int]:
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Scorer:
    """Scores windows with a model; remembers the gate inputs of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, 2, 3 * HIDDEN), np.float32)
        self.rows[0] = 0  # no word

    def learn(self, words: list[str]) -> None:
        first = len(self.ids) + 1
        self.ids.update(zip(words, range(first, first + len(words))))
        if first + len(words) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), first + len(words)), 2, 3 * HIDDEN), np.float32)
            grown[: len(self.rows)] = self.rows
            self.rows = grown
        for low in range(0, len(words), CHUNK):
            part = words[low : low + CHUNK]
            found = _features(self.model, buckets_of(part))
            for at in range(0, len(part), BLOCK):
                # Products of one height: the sums of a row do not depend on how many words are met together.
                block = found[at : at + BLOCK]
                filled = np.zeros((BLOCK, found.shape[1]), np.float32)
                filled[: len(block)] = block
                self.rows[first + low + at : first + low + at + len(block)] = _projected(self.model, filled)[: len(block)]

    def numbered(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.ids))
        if new:
            if len(self.ids) > HELD:
                self.clear()
                new = list(set(words))
            self.learn(new)
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Logits of at most BATCH windows of word numbers (windows x WINDOW, 0: no word)."""
        n, mask = len(windows), None
        if n < BATCH:
            windows = np.concatenate((windows, np.zeros((BATCH - n, WINDOW), windows.dtype)))
        if not windows.all():
            filled = (windows.T > 0).astype(np.float32)
            mask = np.stack([filled, filled[::-1]], axis=1)[..., None]
        gates_in = np.stack([self.rows[windows.T, 0], self.rows[windows.T[::-1], 1]], axis=1)
        return _pool(self.model, _forward(self.model, gates_in, mask), mask)[0][:n]

    def window_logits(self, words: list[str], docs: list[np.ndarray], starts: list[np.ndarray]) -> list[np.ndarray]:
        """Logits of the windows that begin at ``starts`` of documents given as places in ``words``."""
        self.clear()
        self.learn(words)
        rows = []
        for ids, at in zip(docs, starts):
            ids = np.concatenate((ids + 1, np.zeros(max(WINDOW - len(ids), 0), np.int64)))
            rows.append(ids[at[:, None] + np.arange(WINDOW)])
        rows = np.concatenate(rows)
        found = np.concatenate([self.logits(rows[low : low + BATCH]) for low in range(0, len(rows), BATCH)])
        return np.split(found, np.cumsum([len(at) for at in starts])[:-1])

    def text_logits(self, texts: Iterator[str]) -> np.ndarray:
        """The largest window logit of each text."""
        best: list[float] = []
        pending, owners = [], []

        def flush(keep: int) -> None:
            # Full batches only, until the end; memory stays that of one batch and one text.
            nonlocal pending, owners
            if not pending:
                return
            windows, owner = np.concatenate(pending), np.concatenate(owners)
            low = 0
            while len(windows) - low > keep:
                part = slice(low, low + BATCH)
                for o, value in zip(owner[part].tolist(), self.logits(windows[part]).tolist()):
                    best[o] = max(best[o], value)
                low += BATCH
            pending, owners = [windows[low:]], [owner[low:]]

        held = 0
        for text in texts:
            words = text.lower().split()
            if len(self.ids) > HELD:
                flush(0)  # numbers of words are about to change
                held = 0
            ids = self.numbered(words)
            best.append(-np.inf)
            if len(ids) < WINDOW:
                ids = np.concatenate((ids, np.zeros(WINDOW - len(ids), np.int32)))
            starts = np.array(window_starts(len(ids)))
            for low in range(0, len(starts), 4 * BATCH):
                part = starts[low : low + 4 * BATCH]
                pending.append(ids[part[:, None] + np.arange(WINDOW)])
                owners.append(np.full(len(part), len(best) - 1))
                held += len(part)
                if held >= 4 * BATCH:
                    flush(BATCH)
                    held = sum(map(len, pending))
        flush(0)
        return np.array(best)

    def scores(self, texts: Iterator[str]) -> np.ndarray:
        slope, shift = self.model.scale
        return np.round(_sigmoid(slope * self.text_logits(texts) + shift), 6)


def _telling(model: Model, words: list[str], labels: np.ndarray, docs: list[np.ndarray]) -> None:
    """Start the tables with how surely a bucket is more frequent under one label.

    The first component is the log-odds over its standard error, less what chance gives a table of
    so many buckets, so that what is seen in a few documents only starts at zero.
    """
    word, grams, number = buckets_of(words)
    at = np.concatenate(([0], np.cumsum(number)))
    seen = {0: [np.zeros(BUCKETS), np.zeros(BUCKETS)], 1: [np.zeros(BUCKETS), np.zeros(BUCKETS)]}
    for label, ids in zip(labels, docs):
        own = np.unique(ids)
        seen[int(label)][0][np.unique(word[own])] += 1
        mine = np.concatenate([grams[at[i] : at[i + 1]] for i in own.tolist()]) if len(own) else np.zeros(0, np.int64)
        seen[int(label)][1][np.unique(mine)] += 1
    totals = [max(float((labels == v).sum()), 1.0) for v in (0, 1)]
    for kind, target in ((0, model.words), (1, model.grams)):
        p, n = seen[1][kind], seen[0][kind]
        odds = np.log((p + 0.5) / (totals[1] - p + 0.5)) - np.log((n + 0.5) / (totals[0] - n + 0.5))
        error = np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5) + 1 / (totals[1] - p + 0.5) + 1 / (totals[0] - n + 0.5))
        sure = odds / error
        target[:, 0] = np.clip(np.sign(sure) * np.maximum(np.abs(sure) - CHANCE, 0) / 2, -2, 2)


def distinct_texts(texts: list[str]) -> list[int]:
    """Places of the texts that are no near copy of an earlier one.

    Copies would pass for independent witnesses of every rare word they share. Two texts count as
    copies if two of three smallest hashes of their runs of four words agree.
    """
    seen: set[tuple] = set()
    kept = []
    for n, text in enumerate(texts):
        words = text.lower().split()
        runs = [" ".join(words[i : i + 4]).encode() for i in range(max(len(words) - 3, 1))]
        codes = np.array([zlib.crc32(r) for r in runs], np.uint64)
        least = [int(((codes * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in (2654435761, 2246822519, 3266489917)]
        keys = [(i, least[i], j, least[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
        if not any(k in seen for k in keys):
            kept.append(n)
        seen.update(keys)
    return kept


def train(texts: list[str], labels: list[int], prior: float | None = None, windows_per_row: int = 3, rounds: int = 5, least_steps: int = 15, seed: int = 11) -> Model:
    """Fit the network on windows of labelled texts and the probability scale on judgements of unseen texts.

    ``prior`` is the share of label 1 among all rows; without it that of ``labels``.
    """
    truth, share = np.array(labels, np.int64), float(np.mean(labels)) if len(labels) else 0.0
    options = (windows_per_row, rounds, least_steps, seed)
    kept = distinct_texts(texts)
    if 0 < truth[kept].sum() < len(kept):
        texts, truth = [texts[i] for i in kept], truth[kept]
    model = _network(texts, truth, *options)
    if model.constant is not None or min(truth.sum(), (1 - truth).sum()) < 2:
        return model
    # Logits of texts that were learned from are too sure of themselves: every fold is judged by a network without it.
    place = np.where(truth == 1, np.cumsum(truth), np.cumsum(1 - truth)) % FOLDS
    logits, judged = np.zeros(len(truth)), np.zeros(len(truth), bool)
    for fold in range(FOLDS):
        own = np.flatnonzero(place == fold)
        other = np.flatnonzero(place != fold)
        judge = _network([texts[i] for i in other], truth[other], *options)
        if judge.constant is None:
            logits[own] = Scorer(judge).text_logits(texts[i] for i in own)
            judged[own] = True
    logits, truth = logits[judged], truth[judged]
    if not len(truth) or truth.min() == truth.max():
        return model
    prior = share if prior is None else prior
    weights = np.where(truth == 1, prior / truth.mean(), (1 - prior) / (1 - truth.mean()))
    model.scale = _scale(logits, truth, weights)
    return model


def _network(texts: list[str], truth: np.ndarray, windows_per_row: int, rounds: int, least_steps: int, seed: int) -> Model:
    """The network without a scale; a constant if there is one label only, or no word."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, size=0.3: rng.normal(0, size, shape).astype(np.float32)
    model = Model(
        draw(BUCKETS, WIDTH, size=0.05), draw(BUCKETS, WIDTH, size=0.05), draw(3 * WIDTH, 2, 3 * HIDDEN), np.zeros((2, 1, 3 * HIDDEN), np.float32),
        draw(2, HIDDEN, 3 * HIDDEN), draw(2 * HIDDEN), np.append(draw(2 * HIDDEN), 0).astype(np.float32),
    )
    if not len(truth) or truth.min() == truth.max():
        model.constant = float(truth.mean()) if len(truth) else 0.0
        return model
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.lower().split()], np.int64) for t in texts]
    words = list(vocabulary)
    if not words:
        model.constant = float(truth.mean())
        return model
    buckets = buckets_of(words)
    word, grams, number = buckets
    first_gram = np.concatenate(([0], np.cumsum(number)))
    _telling(model, words, truth, docs)

    # First the windows that hold the most telling words and others at random; then, round by round,
    # those the network itself finds most toxic, as the largest window decides about a text.
    hint = np.empty(len(words), np.float32)
    for low in range(0, len(words), CHUNK):
        found = _features(model, buckets_of(words[low : low + CHUNK]))
        hint[low : low + CHUNK] = np.maximum(found[:, 0], found[:, 2 * WIDTH])
    starts = [np.array(window_starts(len(ids))) for ids in docs]
    level = [np.array([hint[ids[s : s + WINDOW]].max(initial=0) for s in at]) for ids, at in zip(docs, starts)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    size, tick = 128, 0
    for turn in range(rounds):
        windows, answers = [], []
        for label, ids, at, own in zip(truth, docs, starts, level):
            top = at[np.argsort(-own, kind="stable")[: windows_per_row - 1]].tolist()
            other = rng.choice(at, 1).tolist() if turn == 0 or not label else []
            for s in sorted({*top, *other}):
                part = ids[s : s + WINDOW] + 1
                windows.append(np.concatenate((part, np.zeros(WINDOW - len(part), np.int64))))
                answers.append(label)
        windows, answers = np.array(windows), np.array(answers, np.float32)
        share = answers.mean()
        weights = np.where(answers > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)
        done = 0
        while done < max(len(windows), least_steps * size):
            order = rng.permutation(len(windows))
            for low in range(0, len(order), size):
                part = order[low : low + size]
                tick += 1
                _step(model, moments, tick, windows[part], answers[part], weights[part], word, grams, number, first_gram)
            done += len(order)
        scorer = Scorer(model)
        level = scorer.window_logits(words, docs, starts)
    return model


def _summed(values: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """A table of ``size`` rows with the sums of ``values`` by their row."""
    out = np.zeros((size, values.shape[1]), np.float32)
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    if len(first):
        out[ordered[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _step(model, moments, tick, windows, answers, weights, word, grams, number, first_gram, rate=RATE):
    """One step of Adam on a batch of windows."""
    ids, place = np.unique(windows, return_inverse=True)
    place = place.reshape(windows.shape)
    known = ids[ids > 0] - 1
    grams_of = np.concatenate([grams[first_gram[i] : first_gram[i + 1]] for i in known.tolist()])
    features = np.zeros((len(ids), 3 * WIDTH), np.float32)
    features[len(ids) - len(known) :] = _features(model, (word[known], grams_of, number[known]))
    projected = _projected(model, features)
    filled = (windows.T > 0).astype(np.float32)
    mask = np.stack([filled, filled[::-1]], axis=1)[..., None]
    gates_in = np.stack([projected[place.T, 0], projected[place.T[::-1], 1]], axis=1)
    keep: list = []
    states = _forward(model, gates_in, mask, keep)
    logit, pooled, weight, both = _pool(model, states, mask)

    d_logit = ((_sigmoid(logit) - answers) * weights / len(answers)).astype(np.float32)
    d_out = np.append(d_logit @ pooled, d_logit.sum())
    d_pooled = d_logit[:, None] * model.out[:-1]
    through = np.einsum("bh,tbh->tb", d_pooled, both)
    d_level = weight * (through - (weight * through).sum(axis=0))
    d_both = weight[..., None] * d_pooled + d_level[..., None] * model.attend
    d_attend = np.einsum("tb,tbh->h", d_level, both)
    d_states = np.stack([d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]], axis=1)
    d_gates = np.zeros_like(gates_in)
    d_recur = np.zeros_like(model.recur)
    d_state = np.zeros_like(states[0])
    for t in range(len(states) - 1, -1, -1):
        state, update, reset, fresh, turned = keep[t]
        d_state = d_state + d_states[t]
        d_step = d_state * mask[t]
        d_fresh = d_step * (1 - update)
        d_update = -d_step * (fresh - state) * update * (1 - update)
        d_raw = d_fresh * (1 - fresh * fresh)
        d_reset = d_raw * turned * reset * (1 - reset)
        d_gates[t] = np.concatenate([d_update, d_reset, d_raw], axis=-1)
        d_turned = np.concatenate([d_update, d_reset, d_raw * reset], axis=-1)
        d_recur += state.transpose(0, 2, 1) @ d_turned
        d_state = d_state - d_step * (1 - update) + d_turned @ model.recur.transpose(0, 2, 1)
    forth = _summed(d_gates[:, 0].reshape(-1, 3 * HIDDEN), place.T.ravel(), len(ids))
    back = _summed(d_gates[:, 1].reshape(-1, 3 * HIDDEN), place.T[::-1].ravel(), len(ids))
    d_projected = np.stack([forth, back], axis=1)
    d_projected[ids == 0] = 0
    d_bias = d_gates.sum(axis=(0, 2))[:, None]
    d_inputs = np.tensordot(features, d_projected, (0, 0))
    d_features = np.tensordot(d_projected, model.inputs, ((1, 2), (1, 2)))[len(ids) - len(known) :]
    d_words = _summed(d_features[:, :WIDTH], word[known], BUCKETS)
    spread = np.repeat(d_features[:, WIDTH : 2 * WIDTH] / number[known][:, None], number[known], axis=0)
    largest = model.grams[grams_of] == np.repeat(features[len(ids) - len(known) :, 2 * WIDTH :], number[known], axis=0)
    spread = spread + largest * np.repeat(d_features[:, 2 * WIDTH :], number[known], axis=0)
    d_grams = _summed(spread, grams_of, BUCKETS)

    shares = [TABLE_SHARE, TABLE_SHARE, 1, 1, 1, 1, 1]
    for share, p, g, (m, v) in zip(shares, model.parameters(), [d_words, d_grams, d_inputs, d_bias, d_recur, d_attend, d_out], moments):
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= (share * rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.99**tick)) + 1e-8)).astype(np.float32)


def _scale(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from the logits of whole texts to their labels."""
    middle, spread = float(logits.mean()), float(logits.std()) or 1.0
    x = np.stack([(logits - middle) / spread, np.ones(len(logits))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ b)
        slope_of = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        step = np.linalg.solve(slope_of, x.T @ (weights * (labels - p)) - 0.5 * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    slope = max(float(b[0]) / spread, 1e-3)
    return slope, float(b[1]) - float(b[0]) * middle / spread


def held_out(key: str = "doc_id"):
    """Whether the CRC-32 of the key as text is divisible by 5 (rows without a key never teach)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        max_rows: int = 4500, max_bytes: int = 40_000, windows_per_row: int = 3) -> Model:
    """Learn from at most ``max_rows`` labelled rows that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    short = docs.where(F.octet_length(F.coalesce(text, F.lit(""))) <= max_bytes).select(key, F.coalesce(text, F.lit("")).alias("_text"))
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    ids = None
    for value, most in ((0, max_rows - max_rows // 3), (1, max_rows // 3)):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64(key), key).limit(most)
        ids = part if ids is None else ids.union(part)
    # At most max_rows ids: a proven bound for the broadcast, and with max_bytes for what is fetched.
    sample = short.join(F.broadcast(ids), key).groupBy(key, "_label").agg(F.min("_text").alias("_text"))
    rows = sorted(sample.collect(), key=lambda r: r[key])
    prior = totals.get(1, 0) / max(sum(totals.values()), 1)
    return train([r["_text"] for r in rows], [r["_label"] for r in rows], prior, windows_per_row)


def _scores_udf(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            if model.constant is not None:
                yield pa.array(np.full(len(batch), model.constant))
            else:
                yield pa.array(scorer.scores(v.as_py() or "" for v in batch))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every row."""
    scored = docs.select(F.col(key), held_out(key).alias("held_out"), _scores_udf(docs, model)(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; the text is judged where it is read."""
    return docs.where(_scores_udf(docs, model)(F.col(text)) < threshold)
