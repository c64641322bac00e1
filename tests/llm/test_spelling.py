from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelloom.llm import spelling


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute(counts):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def last(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], last(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "word string, n long, place int, fore string")
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize(("seed", "letters", "size"), [(1, "ab", 7), (2, "abé÷", 5), (3, "aÿzth", 6)])
def test_variants_equal_brute_force(spark, seed, letters, size):
    """Dense words: runs of one letter, ties in n, chains of forms, words of 0 to ``size`` letters."""
    rng = random.Random(seed)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(0, size))): rng.choice([1, 1, 2, 3, 4, 8, 16, 33]) for _ in range(260)}
    assert found(spark, counts.items()) == brute(counts)


def test_long_words_and_long_chains(spark):
    long = "ab" * 20_000
    counts = {long: 9, long + "c": 3, "x" + long: 1, long[:777] + "é" + long[778:]: 40}
    counts |= {"q" * 5 + "".join("z" if j < k else "y" for j in range(20)): 2**k for k in range(21)}
    got = found(spark, [*counts.items(), (None, 5)])
    assert got == brute(counts)
    assert {r[2] for r in got if r[0].startswith("qqqqq")} == {"q" * 5 + "z" * 20}


def test_no_words_and_one(spark):
    assert found(spark, []) == []
    assert found(spark, [("alone", 4)]) == [("alone", None, "alone", 4, 0, None)]


def test_nodes_over_partitions(spark):
    """Two words have a node in common just where they begin alike, whatever partitions they lie in; places are in code-point order."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randint(0, 9))) for _ in range(900)} | {"a" * 40, "a" * 40 + "b"})
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(w,) for w in words], "word string")
        rows = {r["word"]: (r["nodes"], r["at"]) for r in spelling.with_nodes(df, F.col("word"), "nodes", "at").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len({at >> 40 for _, at in rows.values()}) > 2
    number = {}
    for w, (nodes, _) in rows.items():
        assert len(nodes) == len(w) + 1
        for k, node in enumerate(nodes):
            assert number.setdefault(w[:k], node) == node
    assert len(set(number.values())) == len(number)
    assert sorted(rows, key=lambda w: rows[w][1]) == words


def test_runs_and_vocabulary(spark):
    rows = [(1, "Straße STRASSE-straße ÉCOLE école"), (None, None), (2, ""), (3, "123 !"), (3, "x" * 200_000 + " " + "ab×cd÷ " * 50_000)]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")
    counted = {r["word"]: r["n"] for r in spelling.vocabulary(spelling.runs(docs, "doc_id"), least=1).collect()}
    assert counted == {"straße": 2, "strasse": 1, "École": 1, "école": 1, "ab×cd÷": 50_000, "x" * 200_000: 1}
    assert {r["word"] for r in spelling.vocabulary(spelling.runs(docs), least=2, letters=6).collect()} == {"straße", "ab×cd÷"}
