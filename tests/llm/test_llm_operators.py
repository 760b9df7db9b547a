"""Edge cases of each operator on small tables, against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import llm_brute
from cohortlens.llm import chat, decontaminate, embedding_dedup, html_extract, lexical_search, licenses, line_dedup, mixing, simhash, spelling, token_counts, toxicity, url_filter
from cohortlens.llm import common
from cohortlens.llm.common import ship_package
from cohortlens.llm.components import components

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
TEXTS = [None, "", " ", "\n\n", "One two three four five six", "one  two three\tfour five six", "One two three four five six", LONG, LONG + " end", "ÄÖ ß é", "a\nb\n\nc"]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return table.select("*", *[F.lit("x").alias(c) for c in ("k", "fp", "n", "units", "digest", "score", "source", "tiles", "component")])


def test_token_edges(spark, docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    more = [(100 + i, t) for i, t in enumerate(["  a  b ", " \n x\n\ny", "▁▁a", "<s> </s> <unk>", "x" * 5000, "a \nb", "\t\ta", "日本語 テスト\n", "\x00 a"])]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    found = token_counts.count_tokens(both.union(both), path).collect()
    texts = dict(enumerate(TEXTS)) | dict(more)
    assert len(found) == 2 * len(texts)
    for r in found:
        body = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(body.encode()), len(model.encode(body))), repr(body[:50])
    assert token_counts.count_tokens(both.limit(0), path).count() == 0
    tokenizer = token_counts.json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    found = token_counts.count_tokens(both, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert all(r.n_tokens == len(tokenizer.encode(texts[r.doc_id] or "").ids) for r in found)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n▁ab,é1\t.", max_size=40))
def test_token_split_adds_up(text):
    import public_tokenizers

    lengths = token_counts.piece_lengths(public_tokenizers.path("piece_bpe_32k.model"))
    assert lengths.count(text) == len(lengths.model.encode(text))


def test_simhash_edges(spark, docs):
    prints, named = llm_brute.simhash_groups(list(enumerate(TEXTS)))
    found = simhash.simhash_groups(docs.union(docs)).collect()
    assert len(found) == 2 * len(TEXTS)
    assert all((r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", named[r.doc_id]) for r in found)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(named.values()))
    null_key = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.component_id for r in simhash.simhash_groups(null_key).collect()} == {None}
    assert simhash.keep_one(null_key).count() == len(TEXTS)


def test_keep_one_by_row(spark):
    ship_package(spark)
    plain = [f"{w} river {w}a stone {w}b bridge {w}c tower" for w in ("ash", "beech", "cedar", "dogwood", "elm", "fir")]
    rows = [(7, plain[0]), (7, plain[1]), (7, plain[2]), (3, plain[3]), (7, plain[3]), (8, plain[0]), (9, plain[4]), (9, plain[4]), (None, plain[4]), (None, plain[5]), (None, plain[5])]
    data = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    keyed = [(3, plain[3]), (7, plain[0]), (7, plain[1]), (7, plain[2]), (9, plain[4])]
    found = simhash.keep_one(data, unkeyed_stay=False)
    assert found.columns == data.columns
    assert sorted((r.doc_id or 99, r.text) for r in found.collect()) == keyed + [(99, plain[5])]
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(data).collect() if r.doc_id) == keyed
    assert simhash.keep_one(data).where("doc_id is null").count() == 3


def test_simhash_links_close_prints(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    prints = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))}
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    ship_package(spark)
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2)).collect()}
    pairs = [(a, b) for n, a in enumerate(signed) for b in signed[:n] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    expected = llm_brute.union(signed, pairs)
    assert {p: found.get(p, p) for p in signed} == expected


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [tuple(map(int, p)) for p in rng.integers(2000, 2400, (250, 2))] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links + links, "a long, b long")).collect()}
    assert found == {n: r for n, r in llm_brute.union(sorted({n for p in links for n in p}), links).items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vector_edges(spark):
    ship_package(spark)
    rng = np.random.default_rng(1)
    center = rng.normal(size=24)
    vectors = [center + rng.normal(size=24) * 0.03 for _ in range(700)]
    table = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    table += [(1000 + i, [float(x) for x in rng.normal(size=24)], i % 3) for i in range(100)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0] * 24, [2.0] * 24, [1.0] * 24, [1.0] * 23, [1e200] * 24]
    table += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(3000, [1.0] * 24, None), (3001, [1.0] * 24, 2)]
    links, named = llm_brute.vector_groups([(i, v if v is None or None in v or not any(x == 1e200 for x in v) else [1.0] * 24, label) for i, v, label in table])
    data = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("codes", F.lit(1))
    found = embedding_dedup.embedding_groups(data, block_rows=64).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (n, named[i]) for i, n in links.items()}
    twice = embedding_dedup.embedding_groups(data.where("vec_id in (2006, 2000)").union(data.where("vec_id in (2006, 2000)"))).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in twice) == [(2000, 0, 2000)] * 2 + [(2006, 1, 2006)] * 2
    assert embedding_dedup.embedding_groups(data.limit(0)).count() == 0


def test_passage_edges(spark, docs):
    own = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    passage = [f"Pass{i}" for i in range(60)]
    lines = "\n".join(" ".join(passage[i : i + 4]) for i in range(0, 60, 4))
    planted = [
        own("a", 50) + " " + " ".join(passage) + " " + own("b", 50),
        own("c", 30) + " " + " ".join(passage).upper() + ", " + own("d", 30) + "\nlast line",
        own("e", 30) + "\n" + lines + "\n" + own("f", 30),
        own("g", 9) + " " + " ".join(passage[:25]) + "\n\n" + "\t".join(passage[25:]),
        "日本語" * 30, "前置き" + "日本語" * 30, "x" * 5000, "head " + "x" * 5000, own("h", 30) + "\r\n", own("h", 30),
        " ".join(["round and"] * 100), own("z", 40) + " " + " ".join(["round and"] * 30), own("q", 60) + " " + own("y", 3) + " " + own("q", 60),
    ]
    texts = TEXTS + planted
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_removed", F.lit("x")).withColumn("high", F.lit(1)).withColumn("pos", F.lit(2))
    expected = llm_brute.cut_repeats(list(enumerate(texts)))
    found = line_dedup.remove_repeats(table).collect()
    assert {r.doc_id: (r.text, [(s.start, s.end) for s in r.removed_spans]) for r in found} == expected
    assert "high" in found[0].asDict() and "pos" in found[0].asDict()
    for r in found:
        assert r.n_removed == len(r.removed_spans) and r.removed_chars == sum(s.end - s.start for s in r.removed_spans)
    # The planted passage goes in mid-line, across lines and in lines of four words; what is around it stays.
    removed = {r.doc_id - len(TEXTS): sum(len(texts[r.doc_id][s.start : s.end].split()) for s in r.removed_spans) for r in found}
    assert removed[0] == 0 and all(31 <= removed[i] <= 60 for i in (1, 2, 3)) and removed[8] == removed[9] == 0
    kept = {r.doc_id - len(TEXTS): r.text for r in found}
    assert all(w in kept[1] for w in own("c", 30).split() + own("d", 30).split())
    assert len(kept[10].split()) >= 31
    assert 63 <= len(kept[12].split()) <= 92
    again = line_dedup.remove_repeats(table.union(table)).collect()
    assert sorted((r.doc_id, r.text or "") for r in again) == sorted(2 * [(i, t or "") for i, (t, _) in expected.items()])
    assert line_dedup.remove_repeats(table.limit(0)).count() == 0
    none = line_dedup.remove_repeats(table.withColumn("doc_id", F.lit(None).cast("long")))
    assert none.where("n_removed > 0").count() > 5


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.integers(0, 40), st.integers(50, 70), st.integers(0, 10**6))
def test_passages_of_fifty_words_are_always_found(before, after, length, seed):
    rng = np.random.default_rng(seed)
    passage = [f"w{i}" for i in rng.integers(0, 200, length)]
    texts = [[f"a{i}" for i in range(after)] + passage + [f"b{i}" for i in range(before)], [f"c{i}" for i in range(before)] + passage + [f"d{i}" for i in range(after)]]
    found = []
    for text in texts:
        codes = line_dedup.Words().read(" ".join(text))
        found.append({tuple(text[s : s + 31]) for s in line_dedup.unit_starts(codes, 31, 20)})
    assert found[0] & found[1]


words = st.lists(st.sampled_from("abcde"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(1, 4))
def test_tiles_follow_the_definition(pattern, text, least):
    items = decontaminate.Items([(1, " ".join(pattern))], least)
    expected = llm_brute.tiling(pattern, text, min(least, len(pattern))) if pattern else []
    found = []
    for own, width, i, j in items.matches(items.numbered(text)):
        found = decontaminate.tile(i, j, width, len(items.words[own]))
    assert found == expected


def test_overlap_edges(spark, docs, monkeypatch):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "iota kappa lambda mu. Other words stand here; alpha BETA gamma delta epsilon zeta eta theta!"
    table = spark.createDataFrame([(1, item), (2, "x " + moved), (3, item[:40]), (4, None), (5, ""), (6, LONG + " " + item), (7, "two words"), (1, item)], "doc_id long, text string")
    tests = spark.createDataFrame([(10, item), (11, None), (12, "..."), (13, "Two Words"), (14, item)], "item_id long, text string").withColumn("k", F.lit(1))
    ship_package(spark)
    for block in (10**6, 5):  # all items at once, and one block each
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        found = decontaminate.benchmark_overlaps(table.withColumn("item", F.lit(1)), tests, min_match=4, coverage=0.6).collect()
        assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 10), (1, 10), (1, 14), (1, 14), (2, 10), (2, 14), (6, 10), (6, 14), (7, 13)]
        second = next(r for r in found if (r.doc_id, r.item_id) == (2, 10))
        assert second.coverage == 1 and [(("x " + moved)[t.start : t.end], t.words) for t in second.tiles] == [(moved[moved.index("alpha") : -1], 8), (moved[:20], 4)]
        kept = decontaminate.without_contaminated(table, tests, min_match=4, coverage=0.6)
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.benchmark_overlaps(table.limit(0), tests).count() == 0
    assert decontaminate.benchmark_overlaps(table, tests.limit(0)).count() == 0
    assert decontaminate.without_contaminated(table, tests.limit(0)).count() == 8


def test_gradient():
    rng = np.random.default_rng(2)
    vocabulary = ["alpha", "be", "c", "delta", "epsilons"]
    word, grams, number = toxicity.buckets_of(vocabulary)
    first = np.concatenate(([0], np.cumsum(number)))
    draw = lambda *s: rng.normal(0, 0.5, s)
    h, w = toxicity.HIDDEN, toxicity.WIDTH
    model = toxicity.Model(draw(toxicity.BUCKETS, w), draw(toxicity.BUCKETS, w), draw(3 * w, 2, 3 * h), draw(2, 1, 3 * h), draw(2, h, 3 * h), draw(2 * h), draw(2 * h + 1))
    windows = np.array([[1, 2, 3, 4, 5, 0, 0], [5, 5, 1, 2, 3, 4, 1], [3, 0, 0, 0, 0, 0, 0]])
    answers, weights = np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.5, 2.0])

    def loss():
        rows = np.concatenate([np.zeros((1, 2, 3 * h)), toxicity._projected(model, toxicity._features(model, (word, grams, number)).astype(float))])
        filled = (windows.T > 0).astype(float)
        mask = np.stack([filled, filled[::-1]], axis=1)[..., None]
        states = toxicity._forward(model, np.stack([rows[windows.T, 0], rows[windows.T[::-1], 1]], axis=1), mask)
        p = toxicity._sigmoid(toxicity._pool(model, states, mask)[0])
        return float(-(weights * (answers * np.log(p) + (1 - answers) * np.log(1 - p))).sum() / len(answers))

    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    toxicity._step(model, moments, 1, windows, answers, weights, word, grams, number, first, rate=0.0)
    places = [(0, (word[0], 1)), (1, (grams[0], 2)), (2, (3, 1, 4)), (2, (9, 0, 20)), (3, (0, 0, 2)), (3, (1, 0, 17)), (4, (1, 2, 5)), (4, (0, 3, 20)), (5, (4,)), (6, (3,)), (6, (16,))]
    for which, at in places:
        values = model.parameters()[which]
        kept, step = values[at], 1e-2
        values[at] = kept + step
        high = loss()
        values[at] = kept - step
        low = loss()
        values[at] = kept
        assert moments[which][0][at] / 0.1 == pytest.approx((high - low) / (2 * step), rel=0.05, abs=2e-4), (which, at)


def test_toxicity_edges(spark, docs):
    rng = np.random.default_rng(4)
    plain = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"], 60)) for _ in range(150)]
    table = [(i, t + (" badword " if i % 3 == 0 else " ") + t) for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in table] + [(None, 1, 1), (0, 0, None), (1, 0, 7)], "doc_id long, quality int, toxic int")
    data = spark.createDataFrame([*table, (None, None), (900, None), (901, ""), (902, LONG), (903, LONG + " badword"), (0, "other")], "doc_id long, text string").withColumn("_label", F.lit(1))
    model = toxicity.fit(data, labels)
    found = toxicity.score_texts(data, model).collect()
    assert len(found) == data.count() and all(0 <= r.score <= 1 for r in found)
    scores = {r.doc_id: r.score for r in found}
    assert np.mean([scores[i] for i in range(3, 150, 3)]) > 0.8 > 0.2 > np.mean([scores[i] for i in range(1, 150, 3)])
    assert scores[903] > scores[902] and scores[900] == scores[901] < 0.5
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.fit(data, none).constant == 0
    assert toxicity.fit(data, labels.where("toxic = 1")).constant == 1
    assert {r.score for r in toxicity.score_texts(data, toxicity.fit(data, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score_texts(data.limit(0), model).count() == 0
    same = toxicity.Scorer(model).scores(t or "" for _, t in [*table, (902, LONG)])
    assert [scores[i] for i in range(1, 150)] == same[1:150].tolist()
    texts = [t[: 40 + 37 * i % 700] for i, (_, t) in enumerate(table)] + [LONG[i : i + 900] for i in range(0, 9000, 300)]
    whole = toxicity.Scorer(model).scores(texts)
    for n in (1, 7, 50, 333):
        scorer, parts = toxicity.Scorer(model), []
        for low in range(0, len(texts), n):
            parts += scorer.scores(texts[low : low + n]).tolist()
        assert parts == whole.tolist()


def plain_score(model, text):
    """The score of a text by scalar loops: every window, both directions, step by step."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    words, best = text.lower().split(), -math.inf
    starts = sorted({*range(0, max(len(words) - toxicity.WINDOW, 0), toxicity.STRIDE), max(len(words) - toxicity.WINDOW, 0)})
    features = {}
    for w in set(words):
        word, grams, number = toxicity.buckets_of([w])
        own = [model.grams[g] for g in grams]
        features[w] = [*model.words[word[0]], *[float(sum(g[j] for g in own)) / int(number[0]) for j in range(toxicity.WIDTH)], *[max(g[j] for g in own) for j in range(toxicity.WIDTH)]]
    h = toxicity.HIDDEN
    for start in starts:
        window = words[start : start + toxicity.WINDOW]
        states = [[0.0] * (2 * h) for _ in window]
        for way in (0, 1):
            state = [0.0] * h
            for at in range(len(window)) if way == 0 else reversed(range(len(window))):
                x = features[window[at]]
                gate = [float(model.bias[way, 0, g]) + sum(float(x[i]) * float(model.inputs[i, way, g]) for i in range(len(x))) for g in range(3 * h)]
                turned = [sum(state[i] * float(model.recur[way, i, g]) for i in range(h)) for g in range(3 * h)]
                update = [sigmoid(gate[j] + turned[j]) for j in range(h)]
                reset = [sigmoid(gate[h + j] + turned[h + j]) for j in range(h)]
                fresh = [math.tanh(gate[2 * h + j] + reset[j] * turned[2 * h + j]) for j in range(h)]
                state = [u * s + (1 - u) * f for u, s, f in zip(update, state, fresh)]
                states[at][way * h : (way + 1) * h] = state
        levels = [sum(s * float(a) for s, a in zip(both, model.attend)) for both in states]
        weights = [math.exp(v - max(levels)) for v in levels]
        pooled = [sum(w * both[j] for w, both in zip(weights, states)) / sum(weights) for j in range(2 * h)] if states else [0.0] * (2 * h)
        best = max(best, float(model.out[-1]) + sum(p * float(o) for p, o in zip(pooled, model.out)))
    slope, shift = model.scale
    return sigmoid(slope * best + shift)


def test_toxicity_by_a_plain_loop(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    known = [r for r in rows if r.doc_id in labels]
    model = toxicity.train([r.text for r in known], [labels[r.doc_id] for r in known])
    texts = [r.text for r in rows if r.text and len(r.text) < 2500][:60] + ["", "one", "x " * 100]
    found = toxicity.Scorer(model).scores(texts)
    # Single precision loses digits over the steps of a window in a few texts.
    apart = [abs(plain_score(model, t) - s) for t, s in zip(texts, found)]
    assert np.median(apart) < 1e-5 and max(apart) < 2e-3


def test_mixing(spark):
    sizes = {"a": 1000, "b": 330, None: 70, "c": 5}
    rows = [(i + 10_000 * n, s) for n, (s, size) in enumerate(sizes.items()) for i in range(size)]
    data = spark.createDataFrame(rows, "doc_id long, source string").select("*", *[F.lit(1).alias(c) for c in ("s", "a", "own", "n", "mix_row", "before")])
    for options in ({"block_rows": 4, "parts": 20}, {"block_rows": 1, "weights": {"a": 7, "b": 5, "c": 3}}, {"block_rows": 2000}):
        found = mixing.mix_sources(data, **options).collect()
        expected = llm_brute.mix(rows, **{"parts": 200, **options})
        assert {r.doc_id: (r.mix_block, r.mix_row) for r in found} == expected
        assert len({r.mix_position for r in found}) == len(rows)
    twice = mixing.mix_sources(data.union(data), block_rows=4)
    assert twice.select("mix_position").distinct().count() == 2 * len(rows)
    assert mixing.mix_sources(data.limit(0)).count() == 0
    assert mixing.mix_sources(data.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(rows)
    with pytest.raises(ValueError):
        mixing.mix_sources(data, weights={"a": 0})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_schedule_stays_within_a_block(counts):
    """The brute-force schedule, which the operator must equal, never deviates by a block."""
    slots, length = llm_brute.edf(counts), sum(counts)
    had = [0] * len(counts)
    for t, pick in enumerate(slots, 1):
        had[pick] += 1
        assert all(abs(h - t * n / length) < 1 for h, n in zip(had, counts))


def test_mixing_cuts_heavy_buckets(spark, monkeypatch):
    rows = [(None if i % 3 else 7, "a" if i % 4 else "b", f"text {i}") for i in range(900)] + [(i, "a", "x") for i in range(300)] + [(5, "b", "same")] * 50
    data = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("part", F.lit(1)).withColumn("n", F.lit("x"))
    whole = sorted((tuple(r) for r in mixing.mix_sources(data, block_rows=4).collect()), key=repr)
    monkeypatch.setattr(mixing, "HEAVY", 16)
    assert sorted((tuple(r) for r in mixing.mix_sources(data, block_rows=4).collect()), key=repr) == whole


def test_mixing_tracks_weights(spark):
    weights = {"a": 13, "b": 7, "c": 3, "d": 1}
    rows = [(i, s) for i, s in enumerate(s for s, w in weights.items() for _ in range(30 * w * 2))]
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights=weights, block_rows=2).collect()
    blocks = [s for _, s in sorted({(r.mix_block, r.source) for r in found})]
    assert len(blocks) == 30 * 24
    for t in range(1, len(blocks) + 1):
        for s, w in weights.items():
            assert abs(blocks[:t].count(s) - t * w / 24) < 1


def test_url_rules(spark):
    ship_package(spark)
    urls = [f"https://x.example.net/{'spam/' if i % 4 == 0 else 'news/'}{i}?ref={'bad' if i % 4 == 0 or i % 7 == 0 else 'ok'}" for i in range(400)]
    pages = [(i, u) for i, u in enumerate(urls)] + [(900, None), (901, ""), (902, "no scheme/x"), (903, "ftp://A.Example.ORG/es/x#f"), (904, "http://example.org"), (905, "http://x.com/fr/?q"), (906, "://notorg/es/"), (900, None), (907, "https://other.example.net/spam/?ref=bad")]
    table = spark.createDataFrame(pages, "page_id long, url string").withColumn("tokens", F.lit(1)).withColumn("token", F.lit(1)).withColumn("mined", F.lit("x"))
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)] + [(None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("allow", "com/fr/")]
    found = {r.page_id: r for r in url_filter.judge_urls(table, labels, rules).collect()}
    assert url_filter.judge_urls(table, labels, rules).count() == len(pages)
    assert all(found[i].verdict == ("block" if i % 4 == 0 else "allow") and found[i].rule is None for i in range(400))
    assert (found[903].host, found[903].path, found[903].rule, found[903].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (found[904].path, found[904].rule) == ("", None) and found[905].rule == "com/fr/"
    assert all((found[i].host, found[i].path, found[i].rule, found[i].verdict) == ("", "", None, "allow") for i in (900, 901, 902))
    assert (found[906].host, found[906].rule) == ("notorg", None) and found[907].verdict == "block"
    sets = {i: frozenset(r.tokens) for i, r in enumerate(table.where("page_id < 400").select("page_id", url_filter.tokens(F.col("url")).alias("tokens")).orderBy("page_id").collect())}
    mined, classes = url_filter.mine(table, labels)
    tokens_of = {}
    for r in classes.collect():
        tokens_of.setdefault(r["class"], set()).add(r.token)
    bodies = {frozenset(r.body): (r.freq, r.bad) for r in mined.collect()}
    for body, (freq, bad) in bodies.items():
        having = [i for i, t in sets.items() if all(tokens_of[c] & t for c in body)]
        assert freq == len(having) and bad == sum(i % 4 == 0 for i in having) >= 20 and bad / freq >= 0.8
    # The same addresses as from all combinations of tokens.
    seen = {}
    for i, t in sets.items():
        for n in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), n):
                seen.setdefault(c, []).append(i % 4 == 0)
    plain = [set(c) for c, rows in seen.items() if sum(rows) >= 20 and sum(rows) / len(rows) >= 0.8]
    assert plain and {i for i, t in sets.items() if any(c <= t for c in plain)} == {i for i in range(400) if found[i].mined}
    assert url_filter.judge_urls(table, labels.limit(0), rules).where("mined").count() == 0
    assert url_filter.judge_urls(table.limit(0), labels, rules).count() == 0
    # Addresses that share many tokens, the same evidence in a larger table, and a very long address.
    pairs = "&".join(f"k{i}=v{i}" for i in range(40))
    more = [(1000 + i, f"http://gen.example/{i}?{pairs}" if i < 25 else f"http://fine.example/{i}") for i in range(6000)] + [(9000, "http://gen.example/" + "a/" * 40_000)]
    wide = spark.createDataFrame(more, "page_id long, url string")
    told = spark.createDataFrame([(i, 1, int(i < 1025)) for i, _ in more[:-1]], "doc_id long, quality int, toxic int")
    assert sorted(r.page_id for r in url_filter.judge_urls(wide, told, []).where("mined").collect()) == [*range(1000, 1025), 9000]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<turn>"]), st.text(alphabet="\\<>turnex/t \né#:A", max_size=25)), max_size=5))
def test_chat_round_trip(turns):
    out = chat.compile_template(chat.TEMPLATE)([{"role": r, "text": t} for r, t in turns])
    formatted = "".join(out.pieces)
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in out.spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    render = lambda source, *turns: "".join(chat.compile_template(source)([{"role": r, "text": t} for r, t in turns]).pieces)
    source = "{{ 'a' ~ 1 | upper }}{% for x in messages %}{% if loop.first and not x.role != 'user' %}[{% elif x.role == 'tool' or loop.index == 3 %}!{% else %}-{% endif %}{{ (x.text ~ ' ') | trim | upper }}{% endfor %}"
    assert render(source, ("user", "hi "), ("bot", "yo"), ("bot", "z"), ("tool", "t")) == "a1[HI-YO!Z!T"
    tree = chat.fold(chat.Parser("{% if 'a' == 'a' %}x{{ 'y' | upper }}{% else %}no{% endif %}z").template(), chat.OPERATORS)
    assert tree == (chat.Out(chat.Const("xYz")),)
    bad = ["{% for m in other %}{% endfor %}", "{% for m in messages %}", "{{ m.text }}", "{{ m }}", "{{ 'a'.__class__ }}", "{% import os %}", "{{ 'a' | eval }}", "{% endfor %}",
           "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ ('a' }}", "{{ }}", "{% for m in messages %}{{ messages.text }}{% endfor %}"]
    for source in bad:
        with pytest.raises(chat.TemplateError):
            chat.compile_template(source)


def test_chat_edges(spark):
    ship_package(spark)
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, None, None, "n"), (2, 0, "user", LONG), (None, 0, "assistant", "\\<turn>"), (1, 1, "assistant", "a")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("formatted", F.lit(1))
    formatted = chat.format_conversations(data)
    found = {r.conv_id: r for r in chat.digests(formatted).collect()}
    expected = {1: [("", "n"), ("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], 2: [("user", LONG)], None: [("assistant", "\\<turn>")]}
    assert set(found) == set(expected)
    for key, turns in expected.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert found[key].n_turns == len(turns)
        assert found[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (found[key].loss_chars, found[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(data.limit(0)).count() == 0


def test_chat_in_pieces(spark):
    rows = [(None, i, "assistant" if i % 2 else "user", f"{i} <turn>\\ " + "x" * (i % 50)) for i in range(400)] + [(1, 0, "user", ""), (2, 0, "assistant", "é" * 500)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    small = lambda df: {r.conv_id: tuple(r) for r in df.collect()}
    for template in (chat.TEMPLATE, "a{% generation %}{% for m in messages %}{{ m.text }}{% endfor %}b{% endgeneration %}", "x", "{% for m in messages %}1{% endfor %}{% for m in messages %}{{ m.text }}{% endfor %}"):
        whole = small(chat.format_conversations(data, template))
        pieces = {}
        for r in chat.format_pieces(data, template, least=200).orderBy("conv_id", "piece").collect():
            pieces.setdefault(r.conv_id, []).append(r)
        assert set(pieces) == set(whole)
        for key, found in pieces.items():
            assert [r.start for r in found] == [sum(len(q.formatted) for q in found[:n]) for n in range(len(found))]
            text, learned = "".join(r.formatted for r in found), "".join(r.formatted[s.start - r.start : s.end - r.start] for r in found for s in r.spans)
            assert (sum(r.n_turns for r in found), text) == whole[key][1:3]
            assert learned == "".join(text[s.start : s.end] for s in whole[key][3])
            if template == chat.TEMPLATE:  # no piece holds much more than its limit and a turn
                assert all(len(r.formatted) < 200 + 600 for r in found) and (key is not None or len(found) > 50)
    assert small(chat.conversation_digests(data, least=200)) == small(chat.digests(chat.format_conversations(data)))
    assert chat.conversation_digests(data.limit(0)).count() == 0


PAGE = (
    "<html><head><title>x</title></head><body><div id='cookie-banner'>We use cookies</div><div class=site-top><a href=1>Home</a> <a href=2>News</a></div>"
    "<div class=layout><div class='post-body'><h2>Title {0}</h2><p>Some text &amp; more {0} about <a href=x>link {0}</a> things that is\n long enough.&nbsp;<em>Yes</em>"
    "<p>Second &#x41; para {0} with words and words<br>and words.<ul><li>one {0}<li>two {0}</ul></div><div class='side-col'><p>Popular <a href=1>aaa</a></p></div>"
    "<section id=comments><article class=comment><p>Great post {0}, I liked this very much indeed, really, so much.</p></article></section></div>"
    "<form><input><p>mail</p></form><script>var a='<p>no</p>'</script><footer>Copyright {0}</footer></body></html>"
)
NAMED = "<body><nav>a {0}</nav><main><header>Head {0}</header><article><header><h1>Head {0}</h1></header><p>Body {0}.</p><aside>no {0}</aside><div class='newsletter-box'>no</div></article><div class=comments>c {0}</div></main>"


def test_main_text_edges(spark):
    ship_package(spark)
    pages = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(30)] + [(100 + i, f"http://b.example/{i}", NAMED.format(i)) for i in range(8)]
    odd = [None, "", " ", "<", "<p", "plain &lt;text&gt;", "<article>a<p>b", "<script>x", "<!-- a", "<div>" * 3000 + "y", "<p>" + "<b>" * 3000, "<article><p>a</article><article>b</article>"]
    pages += [(200 + i, None if i % 2 else "no address", t) for i, t in enumerate(odd)] + [(0, "http://a.example/0", PAGE.format(0))]
    data = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("marks", F.lit(1))
    rows = html_extract.extract_main_text(data).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    found = {r.page_id: r.text for r in rows}
    for i in range(30):
        assert found[i] == f"Title {i}\nSome text & more {i} about link {i} things that is long enough. Yes\nSecond A para {i} with words and words and words.\none {i}\ntwo {i}"
    assert all(found[100 + i] == f"Head {i}\nBody {i}." for i in range(8))
    assert [found[200 + i] for i in range(len(odd))] == ["", "", "", "<", "", "plain <text>", "a\nb", "", "", "y", "", "a\nb"]
    assert html_extract.extract_main_text(data.limit(0)).count() == 0


def test_wrapper_folds_repeats_and_options():
    tree = lambda s: html_extract.page_tree(s)
    one = tree("<div><p>a</p><p>b</p><p>c</p></div><hr>")
    two = tree("<div><h2>t</h2><p>a</p></div>")
    wrapper = html_extract.merge(one, two)
    body = wrapper[3][0]
    assert [(n[0], n[1], n[2]) for n in body[3]] == [("h2", False, True), ("p", True, False)]
    assert [(n[0], n[2]) for n in wrapper[3]] == [("div", False), ("hr", True)]
    pairs = tree("<dl><dt>a<dd>b<dt>a<dd>b<dt>a<dd>b</dl>")
    assert [(n[0], n[1]) for n in pairs[3][0][3]] == [("#group dt | dd", True)]


def unnamed(i):
    """A page whose elements have no telling names: the lines around the text are the same on every page."""
    body = "".join(f"<div>Sentence {j} of page {i} tells of thing {i * 7 + j} at length.</div>" for j in range(2 + i % 4))
    return f"<html><body><div>Welcome to our house</div><div><a href=/{i}>Back</a> to start</div><div>{body}</div><div>Since 1990 and so on, in our care</div></body></html>"


def body_of(i):
    return "\n".join(f"Sentence {j} of page {i} tells of thing {i * 7 + j} at length." for j in range(2 + i % 4))


@pytest.mark.parametrize("fan", [64, 2])
def test_wrappers_decide_where_nothing_is_named(spark, monkeypatch, fan):
    """Lines that the host's pages share go, flat or nested, whatever their number of parts; alone no page could tell."""
    monkeypatch.setattr(html_extract, "FAN", fan)
    pages = [(i, f"http://a.example/{i}", unnamed(i)) for i in range(40)]
    flat = "<div>Welcome to our house</div><div>Only text {0} of this page.</div><div>All rights are kept</div>"
    pages += [(100 + i, f"http://b.example/{i}", flat.format(i)) for i in range(40)]
    pages += [(200 + i, f"http://c.example/{i}", "<div>The same text</div><div>on every page</div>") for i in range(9)]
    pages += [(300 + i, f"http://d.example/{i}", flat.format(i)) for i in range(4)]
    article = "<div>Welcome</div><article><h1>Notes</h1><p>Shared words.</p><p>Own words {0}.</p></article>"
    pages += [(400 + i, f"http://e.example/{i}", article.format(i)) for i in range(12)]
    data = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    found = {r.page_id: r.text for r in html_extract.extract_main_text(data).collect()}
    assert len(found) == len(pages)
    assert all(found[i] == body_of(i) for i in range(40))
    assert all(found[100 + i] == f"Only text {i} of this page." for i in range(40))
    assert all(found[200 + i] == "The same text\non every page" for i in range(9))
    assert all(found[300 + i] == f"Welcome to our house\nOnly text {i} of this page.\nAll rights are kept" for i in range(4))
    assert all(found[400 + i] == f"Notes\nShared words.\nOwn words {i}." for i in range(12))
    alone = {r.page_id: r.text for r in html_extract.extract_main_text(data, aligned=False).collect()}
    assert all("Welcome" in alone[100 + i] for i in range(40)) and any(alone[i] != found[i] for i in range(40))


def test_literals_are_anchors():
    """A literal is never folded into what varies, and aligns with itself."""
    known = {html_extract.block_digest(t) for t in ("Top", "End")}
    one, two = (html_extract.page_tree("<div>Top</div>" + "".join(f"<div>{n} {i}</div>" for i in range(n)) + "<div>End</div>", known) for n in (3, 1))
    wrapper = html_extract.merge(one, two)
    assert [(html_extract.plain(n[0]), n[1], html_extract.LITERAL in n[0]) for n in wrapper[3]] == [("div", False, True), ("div", True, False), ("div", False, True)]


symbols = st.lists(st.sampled_from("abcdefgh"), max_size=14)


@settings(max_examples=200, deadline=None)
@given(symbols, symbols, st.sampled_from([0, 10, 250_000]))
def test_matched_places_form_a_common_subsequence(x, y, cells):
    before, html_extract.CELLS = html_extract.CELLS, cells
    try:
        found = html_extract.matched(x, y)
    finally:
        html_extract.CELLS = before
    assert all(x[i] == y[j] for i, j in found)
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))
    assert bool(found) == bool(set(x) & set(y))


def test_long_unclosed_pages_take_time_by_their_length():
    from time import perf_counter

    for markup in ("<div>" * 200_000 + "y", "<p><td>" + "<b>" * 100_000 + "<div>x</div>" * 50_000, "".join(f"<c{i}>t</c{i}>" for i in range(60_000))):
        begun = perf_counter()
        assert html_extract.main_text(markup, None, False)
        assert perf_counter() - begun < 5


spelled = st.lists(st.text(alphabet="abé", min_size=6, max_size=9), min_size=1, max_size=40, unique=True)


@settings(max_examples=150, deadline=None)
@given(spelled, st.integers(0, 10**6))
def test_composition_finds_every_near_pair_once(words, seed):
    """Partitions as the operator makes them, also where each is cut again, against all pairs."""
    counts = {w: 5 + zlib.crc32(f"{seed}{w}".encode()) % 40 for w in words}
    close = llm_brute.near_words(counts)
    expected = {w: (len(close[w]), min(close[w], key=lambda v: (-counts[v], v), default=None)) for w in words}
    rows = [row for w in words for row in spelling.rows_of(w, counts[w], 6)]
    for _ in range(2):
        parts, found = {}, {}
        for part, low, width, tail, name, n, longer, middle in rows:
            parts.setdefault((part, low, width, tail), []).append((name, n, longer, middle))
        names = {hashlib.md5(w.encode()).digest(): w for w in words}
        for (_, low, width, tail), own in parts.items():
            shorter = {m: n for _, n, longer, m in own if not longer}
            more = {m: n for _, n, longer, m in own if longer}
            of = {(longer, m): names[name] for name, _, longer, m in own}
            for key, (near, n, other) in spelling.near_counts(shorter, more, width).items():
                word = of[key]
                entry = found.setdefault(word, [0, []])
                entry[0] += near
                entry[1].append((-n, word[:low] + other + word[len(word) - tail :]))
        assert {w: (found[w][0], min(found[w][1])[1]) if w in found else (0, None) for w in words} == expected
        # Every partition cut until its zone is one place.
        while any(r[2] > 1 for r in rows):
            rows = [new for r in rows for new in (spelling.halves(*r) if r[2] > 1 else [r])]


def test_acceptor_is_minimal():
    strings = ["aab", "abb", "bab", "bbb", "ab", "bb"]
    one = spelling.Acceptor(strings)
    assert sorted(one.common(one.start, one.start)) == sorted(strings)
    # Right languages: all, after a or b, after two points, after b at the end, the empty word.
    languages = {frozenset(s[len(p) :] for s in strings if s.startswith(p)) for s in strings for p in (s[:i] for i in range(len(s) + 1))}
    assert len(one.states) == len(languages)


def test_variant_edges(spark, docs, monkeypatch):
    long = "abcdefghij" * 700
    texts = ["lettering " * 30 + "leterring lettring " * 5 + "Letterings " * 6, None, "", "a b c", "ABCDEF " * 5 + "ÀBCDEF×÷ " * 5, (long + " ") * 25 + (long[:3000] + "x" + long[3000:] + " ") * 5 + (long[:-1] + " ") * 5]
    # Words that agree in their second half, more than a partition may hold.
    texts += [" ".join(f"{a}{b}{c}common" for a in "abcdefgh" for b in "abcdefgh" for c in "ab") + " "] * 5
    table = spark.createDataFrame([*enumerate(texts), (None, "lettering " * 3), (0, texts[0])], "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    expected = llm_brute.variants(rows, every=7)
    for largest in (20_000, 6):
        monkeypatch.setattr(spelling, "LARGEST", largest)
        found = spelling.spelling_variants(table, every=7).collect()
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == expected and len(found) == len(expected)
    plain = {r.word: r for r in spelling.spelling_variants(table, every=None).collect()}
    assert plain["lettring"].form == "lettering" and plain[long[:3000] + "x" + long[3000:]].form == long
    assert spelling.spelling_variants(table.limit(0)).count() == 0


def test_search_edges(spark, docs, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefghijklmnop"), int(n), p=np.arange(1, 17) / 136)) for n in rng.integers(1, 60, 300)]
    rows = [*enumerate(texts), (None, texts[3]), (3, texts[3]), (7, None), (8, ""), (9, "..."), (1000, LONG + " ABC äöü 12"), (None, "Zz " * 50)]
    items = [(0, "A b, c"), (1, "äöü zz nowhere"), (2, None), (3, "nowhere"), (4, " ".join("abcdefghijklmnop")), (None, "p"), (5, "d e"), (5, "f"), (None, "word3")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("score", F.lit("x"))
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    expected = {(i, n, d, s) for i, found in llm_brute.ranked(rows, items).items() for n, (d, s) in enumerate(found, 1)}
    for postings, block in ((1_500_000, 500_000), (40, 4)):
        monkeypatch.setattr(lexical_search, "POSTINGS", postings)
        monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
        found = lexical_search.rank_documents(table, queries).collect()
        assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in found} == expected and len(found) == len(expected)
    assert lexical_search.rank_documents(table.limit(0), queries).count() == 0
    assert lexical_search.rank_documents(table, queries.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.integers(1, 20))
def test_best_positions_stop_early_and_miss_nothing(seed, n_lists, k):
    rng = np.random.default_rng(seed)
    whole, lists = np.zeros(600, np.int64), []
    for _ in range(n_lists):
        docs = np.sort(rng.choice(600, int(rng.integers(1, 600)), replace=False))
        impacts = (rng.pareto(1.0, len(docs)) * 10).astype(np.int64) + 1
        lists.append(lexical_search.ImpactList(docs, impacts))
        whole[docs] += impacts
    docs, scores, read = lexical_search.best_documents(lists, 600, k)
    assert len(set(docs.tolist())) == len(docs) and (whole[docs] == scores).all()
    missed = np.setdiff1d(np.flatnonzero(whole), docs)
    assert not len(missed) or (len(scores) >= k and whole[missed].max() < np.sort(scores)[-k])


def test_best_positions_read_few():
    # The same documents lead both lists: they are read, not the lists.
    docs = np.arange(50_000)
    impacts = np.maximum(1, 10_000 - docs)
    found, _, read = lexical_search.best_documents([lexical_search.ImpactList(docs, impacts)] * 2, 50_000, 10)
    assert read <= 64 and set(range(10)) <= set(found.tolist())


def plain_licenses(rows):
    """Every template laid at every place of every text."""
    stated = licenses.templates()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    texts = [(i, re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))) for i, t in rows]
    df = {w: sum(w in set(words) for _, words in texts) for one in stated for w in (v.decode() for v in one.words)}
    idf = {w: math.log((len(texts) + 1) / (n + 1)) for w, n in df.items()}
    out = []
    for i, words in texts:
        places, base, labels, score = [], set(), set(), 0.0
        for one in stated:
            own = [w.decode() for w in one.words]
            for start in range(-len(own), len(words)):
                there = [n for n, w in enumerate(own) if 0 <= start + n < len(words) and words[start + n] == w]
                if len(there) >= one.need and one.keys <= set(there):
                    labels.add(one.label)
                    if one.base:
                        places.append(start)
                        base.add(one.label)
                    score = max(score, 1.0 if one.base else sum(idf[own[n]] for n in there) / sum(idf[w] for w in own))
        out.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 6)))
    return out


def test_license_edges(spark, docs, monkeypatch):
    notice = licenses.NOTICES[0][0]
    bsd = licenses.NOTICES[7][0]
    texts = TEXTS + [
        "Licensed under the MIT License. the mit\nLICENSE cc-by", "GNU General Public License, gnu general public license", "gnu general public", "mit", "cc", "by cc by",
        notice, notice.upper().replace("ANY PERSON", "someone here"), notice.replace("free of charge", "for a fee"), " ".join(notice.split()[:-2]), " ".join(notice.split()[4:]),
        "x " * 3000 + bsd + " y" * 3000, "Licensed under CC BY-NC 4.0.", LONG + " apache license", "éapache license", "all rights reserved all rights reserved", bsd[:20] + " and " + bsd[20:],
    ]
    rows = [*enumerate(texts), (None, "cc by"), (3, "mit license")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("score", F.lit("x"))
    expected = sorted(plain_licenses(rows), key=repr)
    for portion in (1 << 22, 200):
        monkeypatch.setattr(common, "PORTION", portion)
        assert sorted((tuple(r) for r in licenses.scan_licenses(table).collect()), key=repr) == expected
    assert any("mit" in r[6] and not r[5] for r in expected) and sum("bsd" in r[6] for r in expected) == 2
    assert licenses.scan_licenses(table.limit(0)).count() == 0
    index = licenses.Index(licenses.templates(), *licenses.licence_frequencies(table, licenses.templates(), "text"))
    words = [w for one in licenses.templates() for w in one.words]
    assert index.longest == max(len(n.split()) for n, _, _ in licenses.NOTICES) and set(index.postings) <= set(words)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(40, 400))
def test_portions_give_the_same_licenses(seed, portion):
    rng = np.random.default_rng(seed)
    parts = [n.split() for n, _, _ in licenses.NOTICES] + [p.split() for p in licenses.BASE] + [["word"] * 9]
    words = [w for i in rng.integers(0, len(parts), 12) for w in parts[i] if rng.random() > 0.04]
    index = licenses.Index(licenses.templates(), {b"the": 90, b"of": 80, b"license": 30}, 100)
    text, kept = " ".join(words).encode(), common.PORTION
    common.PORTION = 1 << 22
    whole = index.scan(text)
    common.PORTION = portion
    pieces = index.scan(text)
    common.PORTION = kept
    assert whole == pieces
    own = plain_licenses([(1, text.decode()), (2, None)])[0][1:7]
    assert whole[:6] == own
