from __future__ import annotations

import random
import re

import pytest

from panelloom.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = ["a", "B", "ç", "ab", "x1", "日本", "é", "q r"]
SCHEMA = "doc_id long, text string, overlap string, piece int"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window):
    strings = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            strings.setdefault(tuple(w[s : s + n]), set()).add(name)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in strings}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in strings:
                    hit |= set(range(s, s + n))
                    found |= {str(x) for x in strings[tuple(w[s : s + n])] if x is not None}
        out.append((len(w), len(hit), sorted(found), hit))
    return out


def made(rng, n):
    return "".join(rng.choice(LETTERS) + rng.choice([" ", "  ", "-", "\n", "\x00", " . "]) for _ in range(n))


def found(spark, texts, items, **how):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.overlaps(docs, benchmark, **how).orderBy("doc_id").collect()
    assert [r["piece"] for r in rows] == [1] * len(texts)
    return [(o["n_words"], o["n_hit"], o["items"], {x for h in o["hits"] for x in range(h["first"], h["last"] + 1)}) for o in (r["overlap"] for r in rows)]


@pytest.mark.parametrize("seed", range(40))
def test_search_equals_brute_force(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 2, 3, 5, 10])
    items = [(rng.choice([None, k]), rng.choice([None, "", "!!", made(rng, rng.randint(1, 30))])) for k in range(rng.randint(0, 6))]
    texts = [rng.choice([None, "", made(rng, rng.randint(1, 400))]) for _ in range(rng.randint(1, 6))]
    pieces = [(None if name is None else str(name), " ".join(words(t))) for name, t in items if words(t)]
    got = dc.Search(pieces, window).overlaps([t if t is None else t.encode() for t in texts], [None] * len(texts))
    assert [(g["n_words"], g["n_hit"], g["items"]) for g in got] == [b[:3] for b in brute(texts, items, window)]


@pytest.mark.parametrize("block_bytes", [8_000_000, 300])
def test_operator_equals_brute_force(spark, monkeypatch, block_bytes):
    """One block and many: the blocks' hits are joined, and items cut into pieces lose no window."""
    monkeypatch.setattr(dc, "_PIECE", 5)
    rng = random.Random(5)
    items = [(k, made(rng, rng.randint(0, 40))) for k in range(12)] + [(3, "same a b"), (3, "same a b"), (None, "only here 1 2"), (9, None), (10, "?!")]
    texts = [made(rng, 300), None, "", "...", " ".join(t for _, t in items if t), made(rng, 3) + items[0][1], "same A-b", "only here 1 2 same a", made(rng, 20_000)]
    assert found(spark, texts, items, block_bytes=block_bytes, window=6) == brute(texts, items, 6)


def test_no_rows_on_either_side(spark):
    assert found(spark, ["a b", None], []) == [(2, 0, [], set()), (0, 0, [], set())]
    assert found(spark, [], [(1, "a b")]) == []


def test_copies_and_long_texts(spark):
    passage = " ".join(f"w{k}" for k in range(50))
    long = "x" * 300_000 + " " + "y z " * 200_000 + passage + " end"
    got = found(spark, [passage] * 30 + [long, long.upper()], [(k, passage) for k in range(40)])
    assert [g[:2] for g in got] == [(50, 50)] * 30 + [(400_052, 50)] * 2
    assert all(g[2] == sorted(map(str, range(40))) for g in got)
    assert got[-1][3] == set(range(400_001, 400_051))


def test_windows_of_ten_words_and_short_items(spark):
    w = [f"w{k}" for k in range(30)]
    items = [(1, " ".join(w)), (2, "short one")]
    texts = [" ".join(w[5:14]), " ".join(w[5:15]), "a SHORT, one b short", " ".join(w[:10] + ["x"] + w[10:20])]
    assert found(spark, texts, items) == [(9, 0, [], set()), (10, 10, ["1"], set(range(10))), (5, 2, ["2"], {1, 2}), (21, 20, ["1"], set(range(10)) | set(range(11, 21)))]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, None, None, None)], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r["doc_id"] for r in dc.without_leaks(docs, benchmark, max_share=0.4).collect() if r["doc_id"] is not None) == [0, 2]
    assert dc.without_leaks(docs, benchmark).columns == docs.columns


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    plain = ("é" * 70_000 + " x ").encode() * 3
    whole = dc.Words(plain).hash
    monkeypatch.setattr(dc, "_SLICE", 1000)
    assert (dc.Words(plain).hash == whole).all()
    assert whole[0] == whole[2] == whole[4] != whole[1]


def test_a_window_has_a_word(spark):
    docs = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="one word"):
        dc.overlaps(docs, docs.selectExpr("doc_id AS item_id", "text"), window=0)
