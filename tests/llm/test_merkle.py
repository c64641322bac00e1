from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelloom.llm import merkle

COLUMNS = ["doc_id", "lang", "n", "text"]
SCHEMA = "doc_id long, lang string, n int, text string, __row string, part int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(leaves):
    """(root, siblings of each leaf level by level) of one tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels[-1][0], [[(lev[(k >> d) ^ 1] if (k >> d) ^ 1 < len(lev) else None) for d, lev in enumerate(levels[:-1])] for k in range(len(leaves))]


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, siblings without gaps)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = climb([trees[g][0] for g in order]) if order else (None, [])
    out = []
    for g, up in zip(order, above, strict=True):
        for (known, number, leaf), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((number if known else None, leaf, trees[g][0], root, [s for s in path + up if s]))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    got = merkle.manifest(df, COLUMNS, "lang", "doc_id").select("*", merkle.proof().alias("proof"), merkle.refolded().alias("again")).collect()
    assert all(r["again"] == r["root"].hex() for r in got)
    return sorted(((r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), r["proof"]) for r in got), key=str)


@pytest.mark.parametrize("levels", [2, 8])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    """Trees of 1 to 300 leaves, nulls, repeated rows and ids, a third of all rows with one id."""
    monkeypatch.setattr(merkle, "_LEVELS", levels)
    rng = random.Random(levels)
    rows = [(k, rng.choice(["en", "de", None, "ß", "z" * 50, "é"]), rng.choice([None, k]), rng.choice([None, "", f"text {k} é日本"])) for k in range(300)]
    rows += [(5000, f"l{k}", 1, "lone") for k in range(9)] + [(7, "en", 1, "same")] * 60 + [(7, "en", 1, f"t{k}") for k in range(40)] + [(None, None, None, None)] * 3
    rows += [(k, "power", 0, "") for k in range(64)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17])
def test_one_group(spark, n):
    rows = [(k, "en", k, "x" * (100_000 if k == 1 else k)) for k in range(n)]
    assert found(spark, rows) == brute(rows)


def test_each_row_a_group(spark):
    rows = [(k, f"g{k:03}", None, None) for k in range(70)]
    assert found(spark, rows) == brute(rows)


def test_tampering_shows_where_it_is(spark):
    rows = [(k, "en" if k % 3 else None, k, "t") for k in range(50)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    claimed = merkle.leaf([F.when(F.col("doc_id").isin(4, 9, 20), F.col(c) + 1).otherwise(F.col(c)) if c == "n" else F.col(c) for c in COLUMNS])
    got = merkle.manifest(df, COLUMNS, "lang", "doc_id", {"claimed": claimed})
    assert {r["doc_id"] for r in got.where(merkle.refolded("claimed") != F.lower(F.hex("root"))).collect()} == {4, 9, 20}
    with pytest.raises(ValueError, match="has the name"):
        merkle.manifest(df, COLUMNS, "lang", "doc_id", {"path": claimed})


def test_numbers_over_many_partitions(spark):
    """One group over all range partitions; rows that tie get places of their own."""
    df = spark.range(0, 3000).selectExpr("CAST(id % 7 AS STRING) AS v", "IF(id % 3 = 0, 'hot', CAST(id % 5 AS STRING)) AS g").repartition(6)
    got = merkle.numbered(df, "g", ["v"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["place"], r["v"], r["size"], r["tree"]))
    for rows in by.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and [r[1] for r in rows] == sorted(r[1] for r in rows)
        assert {r[2] for r in rows} == {len(rows)} and len({r[3] for r in rows}) == 1
    assert len({rows[0][3] for rows in by.values()}) == len(by) and sum(map(len, by.values())) == 3000


@pytest.mark.parametrize(("size", "depth"), [(1, 0), (2, 1), (3, 2), (4, 2), (5, 3), (2**29, 29), (2**29 + 1, 30), (2**40, 40)])
def test_depth_in_whole_numbers(spark, size, depth):
    assert spark.range(1).select(merkle._depth(F.lit(size).cast("long"))).first()[0] == depth
