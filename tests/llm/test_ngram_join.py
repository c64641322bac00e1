from __future__ import annotations

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from panelloom.llm import ngram_join
from panelloom.llm.components import connected_components
from panelloom.llm.signature_tree import linked

SCHEMA = "doc_id long, text string, component_id string"


def brute(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """Size and least linked id of each document, on words."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    inverted = collections.defaultdict(list)
    for i in sorted(sets):
        for j, k in collections.Counter(j for s in sets[i] for j in inverted[s]).items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            inverted[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def made(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], SCHEMA)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df, **options).collect()}


def varied(seed: int, n: int) -> dict[int, str | None]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choices(words, k=30))
    texts: dict[int, str | None] = {}
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.4:
            base = (texts[rng.choice(list(texts))] or "a b").split()
            for _ in range(rng.randint(0, 3)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            texts[i] = " ".join(base)
        elif kind < 0.6:
            texts[i] = passage + " " + " ".join(rng.choices(words, k=rng.randint(0, 40)))
        else:
            texts[i] = " ".join(rng.choices(words, k=rng.randint(0, 70)))
    return texts


@pytest.mark.parametrize("block", [1024, 3])
def test_equals_brute_force(spark, block):
    texts = varied(block, 150)
    texts |= {1000: None, 1001: "", 1002: " \t\n", 1003: "One", 1004: "one", 1005: "a b c d", 1006: "A B C D", 1007: "a b c d e", 1008: "é É", 1009: "É é"}
    texts |= {2000 + k: " ".join(f"x{j}" for j in range(40)) + f" end{k}" for k in range(20)}
    assert made(spark, texts, block=block, anchors=1) == brute(texts)


@pytest.mark.parametrize(("hot", "bits"), [(2, (12, 24)), (4, (3, 5)), (10**9, (12, 24))])
def test_hot_tokens_and_few_buckets(spark, monkeypatch, hot, bits):
    """The result is the same whether tokens go to their bucket or past it, in any number of buckets."""
    for name, value in (("_HOT", hot), ("_BITS", bits), ("_HOT_ROW", 7), ("_AT_ONCE", 50), ("_FLUSH", 200)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = varied(11, 120)
    texts |= {1000 + k: " ".join(f"x{j}" for j in range(40)) + f" end{k}" for k in range(30)}
    texts |= {2000 + k: texts[1000 + k % 5] for k in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()}
    assert got == brute(texts)


def test_hot_tokens_are_spread(monkeypatch):
    """A passage of all texts goes past its bucket: what a bucket gets doesn't grow with the texts that have it."""
    monkeypatch.setattr(ngram_join, "_FLUSH", 2000)
    passage = " ".join(f"p{k}" for k in range(60))
    sizes = {}
    for n in (200, 2000):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([f"{passage} own{i} a b c d e" for i in range(n)])], names=["doc_id", "text"])
        rows = pa.Table.from_batches(list(ngram_join._deal(5, 4, 5, 12)(batch.slice(i, 50) for i in range(0, n, 50)))).to_pylist()
        passing = sum(len(r["sets"]) // 8 for r in rows if r["bucket"] == ngram_join._HOT_PAIRS)
        sizes[n] = max(sum(len(r["sets"] or b"") // 8 for r in rows if r["bucket"] == b) for b in {r["bucket"] for r in rows if r["bucket"] >= 0})
        assert passing > 20 * n and len({r["spread"] for r in rows if r["bucket"] == ngram_join._HOT_PAIRS}) > 3
    assert sizes[2000] < 5 * max(sizes[200], 10)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert got == brute(texts)


def test_exactly_at_the_threshold(spark):
    a = " ".join(f"a{k}" for k in range(12))  # 8 shingles
    assert made(spark, {1: a, 2: a + " z", 3: a + " z y", 4: a + " z y x"}) == brute({1: a, 2: a + " z", 3: a + " z y", 4: a + " z y x"})


def test_empty_table_and_null_ids(spark):
    assert made(spark, {}) == {}
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()), key=str)
    assert rows == [(5, 5), (5, 5), (None, None), (None, None)]


def test_keep_one(spark):
    df = spark.createDataFrame([(3, "a b c d e f g", "en"), (2, "a b c d e f g", "en"), (2, "a b c d e f g", "en"), (9, "other words here now", "de"), (None, "a b c d e f g", "en")], "doc_id long, text string, lang string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 2), (False, 9), (True, None)]


def test_tree_against_all_pairs():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(120):
        if sets and rng.random() < 0.6:
            s = sets[rng.integers(len(sets))].copy()
            s[: max(1, len(s) // 12)] = rng.integers(0, 2**63, max(1, len(s) // 12), dtype=np.uint64)
            sets.append(np.unique(s))
        else:
            sets.append(np.unique(rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)))
    label = linked(sets)
    root = list(range(len(sets)))
    for _ in sets:
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    root[i] = root[j] = min(root[i], root[j])
    assert [[label[i] == label[j] for j in range(len(sets))] for i in range(len(sets))] == [[root[i] == root[j] for j in range(len(sets))] for i in range(len(sets))]


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 101), (103, 102)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 102, 103: 102}


def test_units_of_a_group_without_a_main_class_hold_two_blocks(spark, monkeypatch):
    shared = " ".join(f"form{i}" for i in range(40))
    texts = {i: shared + "".join(f" field{i}x{k}" for k in range(12)) for i in range(300)}
    texts |= {1000 + i: texts[i] + f" more{i}" for i in range(0, 300, 10)}
    largest, links = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda units, *a: largest.append(units.groupBy("unit").count().agg({"count": "max"}).first()[0]) or links(units, *a))
    rows = made(spark, texts, block=32)
    assert len(largest) == 2 and max(largest) < 2 * 32 * 1.6
    assert rows == brute(texts)


def test_keep_one_judges_repeated_ids_by_text(spark):
    one, two = "a b c d e f g", "other words stand here for once"
    rows = [(1, one), (5, one), (5, two), (5, two.upper()), (7, two), (8, ""), (8, "")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"].lower()) for r in kept.collect()) == [(1, one), (5, two), (8, "")]


def test_keep_one_keeps_unlinked_texts_under_one_id(spark):
    """Texts without a word in common stay whatever ids they share; of linked ones under one id, one stays."""
    base = [f"{x}{k}" for k in range(12) for x in "ab"]
    near = [*base[:-1], "other"]
    rows = [(5, "one two three four five six", "x"), (5, "red green blue black white grey", "y"), (6, "sun moon star sky cloud rain", "z"), (7, "cat dog cow pig hen fox", "w")]
    rows += [(5, " ".join(base), "p"), (5, " ".join(near), "q"), (4, None, "n"), (4, "", "e"), (4, "  ", "s"), (4, "", "e2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __set string")
    kept = ngram_join.keep_one(df, den=10, num=8)
    got = sorted((r["doc_id"], r["text"], r["__set"]) for r in kept.where("text is not null and trim(text) <> ''").collect())
    assert kept.columns == df.columns
    assert {g[2] for g in got} >= set("xyzw")
    assert len(got) == 5 and {g[2] for g in got} - set("xyzw") <= {"p", "q"}
    assert sorted((r["text"] is None, r["text"] or "") for r in kept.where("doc_id = 4").collect()) == [(False, ""), (False, "  "), (True, "")]


def test_keep_one_of_no_rows_long_texts_and_repeats(spark):
    schema = "doc_id long, text string, lang string"
    assert ngram_join.keep_one(spark.createDataFrame([], schema)).collect() == []
    long = " ".join(f"w{k}" for k in range(100_000))
    rows = [(2, long, "b"), (2, long, "a"), (2, long.upper(), "c"), (3, long + " end", "d")] + [(9, "a b c d e f", "z")] * 50
    for _ in range(2):  # the same rows whatever the order of the table
        kept = sorted((r["doc_id"], r["text"] == long.upper(), r["lang"]) for r in ngram_join.keep_one(spark.createDataFrame(rows, schema)).collect())
        assert kept == [(2, True, "c"), (9, False, "z")]
        rows.reverse()
