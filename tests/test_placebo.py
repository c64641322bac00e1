from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_dispatch_and_sufficient import made_panel

from panelloom.operators import placebo, sufficient, windows


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_draws_are_permutations(n):
    for draw in range(5):
        to = placebo.moved(np.arange(n), np.full(n, n), np.full(n, draw))
        assert sorted(to) == list(range(n))


def test_places_of_draws_are_even():
    n, draws = 10, 6000
    x = np.stack([placebo.moved(np.full(draws, p), np.full(draws, n), np.arange(draws)) for p in range(n)])
    counts = np.stack([np.bincount(row, minlength=n) for row in x])
    assert (abs(counts - draws / n) < 5 * (draws / n) ** 0.5).all()
    together = np.zeros((n, n))
    np.add.at(together, (x[0], x[1]), 1)  # two actors' places
    pairs = together[~np.eye(n, dtype=bool)]
    assert np.trace(together) == 0 and (abs(pairs - draws / 90) < 5 * (draws / 90) ** 0.5).all()


@pytest.fixture(scope="module")
def stats(spark):
    return sufficient.statistics(windows.windows(made_panel(spark), [2003, 2004], 3))


def members_of(spark):
    return spark.createDataFrame([(a, None if a > 8 else "xy"[a % 2], a % 3, a < 2) for a in range(12)], "actor long, block string, layer int, stays boolean")


def test_scores_are_those_of_the_permuted_blocks(spark, stats):
    members = members_of(spark)
    got = {(r["draw"], r["test_year"]): r for r in placebo.placebo_scores(stats, members, 4, ["layer"], F.col("stays")).collect()}
    rows = members.collect()
    variants = []
    for draw in range(-1, 4):
        groups = {}
        for r in sorted(rows, key=lambda r: (r["block"] is not None, r["block"] or "", r["actor"])):
            groups.setdefault((r["layer"], r["stays"]), []).append(r)
        for (_, stays), group in groups.items():
            n = len(group)
            to = range(n) if stays or draw < 0 else placebo.moved(np.arange(n), np.full(n, n), np.full(n, draw))
            variants += [(str(draw), r["actor"], group[k]["block"]) for r, k in zip(group, to, strict=True)]
    assert len(variants) == 5 * 12
    want = sufficient.scores(stats, spark.createDataFrame(variants, "variant string, actor long, block string")).collect()
    assert len(want) == len(got) == 10
    for r in want:
        found = got[int(r["variant"]), r["test_year"]]
        assert all(found[c] == pytest.approx(r[c], abs=1e-12) for c in ("n_actors", "base_r2", "mixed_r2", "delta"))


def test_share_of_better_placebos(spark):
    means = spark.createDataFrame([(-1, 0.2), (0, 0.1), (1, 0.2), (2, 0.3), (3, 0.0)], "draw long, delta double")
    r = placebo.placebo_summary(means).first()
    assert (r["real"], r["n"], r["p"]) == (0.2, 4, 0.5) and r["mean"] == pytest.approx(0.15) and r["z"] == pytest.approx(0.05 / np.std([0.1, 0.2, 0.3, 0.0]))
    none = placebo.placebo_summary(means.where("draw < 0")).first()
    assert (none["real"], none["p"], none["z"], none["n"]) == (0.2, None, None, 0)


def test_halves_share_no_actor_and_leave_none_out(spark, stats):
    halves = placebo.half_scores(stats, members_of(spark), 3)
    whole = placebo.placed(members_of(spark))
    assert sorted(r["place"] for r in whole.collect()) == list(range(12)) and {r["total"] for r in whole.collect()} == {12}
    assert {r["half"] for r in halves.collect()} == {"0", "1"} and {r["split"] for r in halves.collect()} == {0, 1, 2}


def test_nothing_comes_of_nothing(spark, stats):
    assert placebo.placebo_scores(stats.limit(0), members_of(spark), 2).count() == 0 == placebo.placebo_scores(stats, members_of(spark).limit(0), 2).count()
