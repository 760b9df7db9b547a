"""The bound queries: against SQL, against plain versions, and the pipeline stage by stage."""

from __future__ import annotations

import importlib
import os
import re

import numpy as np
import pytest
from conftest import MEDIUM, SMALL

import llm_brute
import oracle
from cohortlens.llm import toxicity
from cohortlens.llm.queries import ORACLES, QUERIES


def rows(spark, name, sf=SMALL):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def test_names():
    found = {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}
    assert found == set(range(1, 14))
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(MEDIUM), QUERIES[name], ORACLES[name], MEDIUM) is None


def test_tokens(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {i: len(model.encode(t or "")) for i, t, *_ in rows(spark, "documents", MEDIUM)}
    found = QUERIES["op1_token_counts"](spark, MEDIUM).collect()
    assert {r.doc_id: r.n_tokens for r in found} == expected
    assert all(r.over_limit == (r.n_tokens > 4096) for r in found)


def test_simhash(spark):
    prints, named = llm_brute.simhash_groups([(r[0], r[1]) for r in rows(spark, "documents")])
    found = QUERIES["op4_simhash_dedup"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id, r.kept) for r in found} == {i: (f"{p:016x}", named[i], named[i] == i) for i, p in prints.items()}


def test_vectors(spark):
    links, named = llm_brute.vector_groups(rows(spark, "embeddings"))
    found = QUERIES["op2_embedding_dedup"](spark, SMALL).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (n, named[i]) for i, n in links.items()}


def test_variants(spark):
    expected = llm_brute.variants([(r[0], r[1]) for r in rows(spark, "documents", MEDIUM)])
    found = QUERIES["op12_spelling_variants"](spark, MEDIUM).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == expected and len(found) == len(expected)
    assert sum(r.form is not None for r in found) > 10


def test_overlaps(spark):
    items = rows(spark, "benchmark")
    expected = {}
    for i, text, *_ in rows(spark, "documents"):
        words = " ".join(re.findall(r"\w+", text.lower()))
        for item, body in items:
            own = re.findall(r"\w+", body.lower())
            # Nothing is covered to 0.7 without a run of a fifth of the words.
            if any(" ".join(own[k : k + 5]) in words for k in range(0, len(own), 5)) and (c := llm_brute.coverages(text, [(item, body)])[item]) >= 0.7:
                expected[i, item] = round(c, 9)
    found = QUERIES["op9_decontamination"](spark, SMALL).collect()
    assert expected and {(r.doc_id, r.item_id): round(r.coverage, 9) for r in found} == expected


def test_toxicity_held_out(spark):
    labels = {r[0]: r[2] for r in rows(spark, "labels", "/root/testdata/sf0.1")}
    found = [r for r in QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    truth, score = np.array([labels[r.doc_id] for r in found]), np.array([r.score for r in found])
    assert all(r.predicted == (r.score >= 0.5) for r in found)
    pairs = (score[truth == 1][:, None] > score[truth == 0]) + 0.5 * (score[truth == 1][:, None] == score[truth == 0])
    assert pairs.mean() > 0.95
    assert ((score >= 0.5) == truth).mean() > 0.97


def test_main_text(spark):
    import html

    def article(page):
        body = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
        blocks = [re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:p|h\d)[^>]*>", body)]
        return "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)

    expected = {i: (u, article(h), len(article(h))) for i, u, h in rows(spark, "pages", MEDIUM)}
    found = QUERIES["op3_html_extraction"](spark, MEDIUM).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in found} == expected


def brute_pipeline(spark, sf_dir):
    docs = {r[0]: list(r) for r in rows(spark, "documents", sf_dir)}
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    order = sorted(docs)
    scores = toxicity.Scorer(model).scores(docs[i][1] or "" for i in order)
    docs = {i: docs[i] for i, s in zip(order, scores) if s < 0.5}
    _, named = llm_brute.simhash_groups([(i, d[1]) for i, d in docs.items()])
    docs = {i: d for i, d in docs.items() if named[i] == i}
    for i, (text, spans) in llm_brute.cut_repeats([(i, d[1]) for i, d in docs.items()]).items():
        if spans:
            docs[i][1], docs[i][4] = text, len(text)
    docs = {i: d for i, d in docs.items() if d[1].strip() or not d[4]}
    items = rows(spark, "benchmark", sf_dir)
    heads = [(i, b, " ".join(re.findall(r"\w+", b.lower())[:5])) for i, b in items]
    for i, d in list(docs.items()):
        words = " ".join(re.findall(r"\w+", d[1].lower()))
        near = [(k, b) for k, b, _ in heads if any(" ".join(w) in words for w in zip(*[re.findall(r"\w+", b.lower())[n::1] for n in range(5)]))]
        if any(c >= 0.7 for c in llm_brute.coverages(d[1], near).values()):
            del docs[i]
    places = llm_brute.mix([(i, d[3]) for i, d in docs.items()])
    return {i: (*d, places[i][0], places[i][1], places[i][0] * 64 + places[i][1]) for i, d in docs.items()}


def test_pipeline(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "source_mixing"]
    found = {r.doc_id: tuple(r) for r in pipeline.run(spark, SMALL).collect()}
    expected = brute_pipeline(spark, SMALL)
    assert 0 < len(found) < len(rows(spark, "documents"))
    assert found == expected


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    pipeline = importlib.import_module("corpus_pipeline")
    names = "s a b n own before breaks k tk spans pos n_removed removed_spans fp row t mix_block mix_position item coverage component_id score length".split()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (None, " \n ", None, "x", 3)], docs.schema)
    docs = docs.union(odd).select("*", *[F.lit(1).alias(c) for c in names])
    for name, stage in pipeline.STAGES:
        kept = stage(spark, docs, SMALL)
        assert 0 < kept.count() <= docs.count(), name
        assert set(kept.columns) >= set(docs.columns), name
        empty = stage(spark, docs.limit(0), SMALL)
        assert empty.count() == 0 and set(empty.columns) >= set(docs.columns), name
    assert os.path.isdir(SMALL)
