from __future__ import annotations

import hashlib
import re

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from panelloom.llm import queries  # noqa: E402
from tests.llm.test_ngram_join import brute  # noqa: E402
from tests.llm.test_text_operators import base_spans, word_counts  # noqa: E402


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "PII", "mixing sources to target weights", "BPE encoding and decoding"]
    kept = stages["quality rules"](spark, docs, sf)
    assert kept.columns == columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows and not any(word_counts(r["text"])[5] for r in rows.values())
    single = stages["n-gram Jaccard join"](spark, kept, sf)
    want = {i for i, (_, c) in brute({i: r["text"] for i, r in rows.items()}).items() if i == c}
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(want)
    clean = stages["PII"](spark, single, sf)
    assert clean.columns == columns
    for r in clean.collect():
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not base_spans(rows[r["doc_id"]]["text"]) and not re.search(r"[0-9]{3}", rows[r["doc_id"]]["text"]):
            assert r["text"] == rows[r["doc_id"]]["text"]
    mixed = stages["mixing sources to target weights"](spark, clean, sf)
    assert mixed.columns == columns and mixed.select("doc_id").distinct().count() > 0.6 * len(want)
    tokens = stages["BPE encoding and decoding"](spark, mixed, sf)
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in tokens.collect())


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_stages_on_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_all_queries_are_named_by_operator():
    assert sorted(int(re.match(r"op([0-9]+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
