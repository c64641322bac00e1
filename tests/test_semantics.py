from __future__ import annotations

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelloom.functions import distributions as D
from panelloom.functions import order as O
from panelloom.functions import semantics as S
from panelloom.operators import autoregression as ar
from panelloom.operators import flows, pit, portfolio, scoring, studies, windows
from panelloom.operators import normalise as N
from panelloom.schema import assert_columns, nan_to_null


def panel(spark, matrix, start=2000):
    """Rows are quarters, columns actors."""
    rows = [(a, dt.date(start + q // 4, 3 * (q % 4) + 1, 1), v) for q, line in enumerate(matrix) for a, v in enumerate(line)]
    return spark.createDataFrame(rows, "actor long, period date, value double")


def column(df, name, keys=("period", "actor")):
    return [r[name] for r in df.orderBy(*keys).collect()]


def test_pct_rank_ties_and_nulls(spark):
    p = panel(spark, [(0.1, 0.2, 0.3), (0.2, 0.2, 0.5), (0.3, None, 0.3), (0.4, 0.1, 0.1)])
    got = [x if x is None else round(x, 9) for x in column(N.cross_section_rank(p), "rank")]
    assert got == [0.333333333, 0.666666667, 1, 0.5, 0.5, 1, 0.75, None, 0.75, 1, 0.5, 0.5]


@pytest.mark.parametrize("values", [list(range(1, 11)), [5, 8, 5, 7, 3, 1], [1, 1, 1, 1], [2], [3, 1, 2, 2, 2, 9, 9, 4]])
def test_quantile_buckets_equal_qcut(spark, values):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)] + [(1, 99, None)], "g int, i int, x double")
    got = {r["i"]: r["bucket"] for r in O.quantile_bucket(df, "x", "g").collect()}
    try:
        want = (pd.qcut(pd.Series(values, dtype=float), 5, labels=False, duplicates="drop") + 1).tolist()
    except (ValueError, IndexError):
        want = [1] * len(values)
    want = [1 if w != w else int(w) for w in want]
    assert [got[i] for i in range(len(values))] == want and got[99] is None


def test_recursive_minmax_and_degenerate_rules(spark):
    p = panel(spark, [(3.0,), (5.0,), (4.0,), (7.0,), (1.0,)])
    assert column(N.recursive_minmax(p), "scaled") == [0.5, 1, 0.5, 1, 0]
    flat = panel(spark, [(2.0,), (2.0,), (None,)])
    assert column(N.time_series_minmax(flat), "scaled") == [None, None, None]
    assert column(N.time_series_minmax(flat, degenerate=0.5), "scaled") == [0.5, 0.5, None]


def test_compound_survives_total_loss(spark):
    p = panel(spark, [(0.1,), (-1.0,), (0.5,), (None,)])
    w = Window.partitionBy("actor").orderBy("period").rowsBetween(-1, 0)
    assert column(p.withColumn("c", S.compound(F.col("value"), w, 2)), "c") == [None, -1.0, -1.0, None]


def test_pooled_ar1_fixture(spark):
    p = panel(spark, [(0.1, 0.2), (0.3, 0.2), (0.5, 0.4), (0.4, 0.6), (0.0, 0.0)], 2000)
    rows = windows.windows(p, [2001], 1, least_actors=2)
    assert ar.rho(rows, []).first()["rho"] == pytest.approx(0.3236714976)
    preds = column(ar.forecasts(rows, {"pred": []}), "pred")
    assert preds == pytest.approx([0.34927536, 0.43091787])
    assert column(ar.ewm_mean(rows), "ewm", ["actor"]) == pytest.approx([0.33280915, 0.36018167])


def test_windows_impute_and_guard(spark):
    p = panel(spark, [(0.1, 0.2), (None, 0.2), (0.5, 0.4), (0.4, 0.6), (0.8, 0.0)])
    full = windows.windows(p, [2001], 1, least_actors=2).where("actor = 0 and period = date'2000-04-01'").first()
    causal = windows.windows(p, [2001], 1, impute="train", least_actors=2).where("actor = 0 and period = date'2000-04-01'").first()
    assert full["value"] == pytest.approx(1.8 / 4) and causal["value"] == pytest.approx(1.0 / 3)
    assert windows.windows(p, [2001], 1, least_actors=3).count() == 0
    with pytest.raises(ValueError):
        windows.windows(p, [2001], impute="no")


def test_scores_fixtures(spark):
    df = spark.createDataFrame([(1, 0, 0.4, 0.5), (1, 1, 0.5, 0.5), (1, 2, 0.6, 0.7), (1, 3, 0.7, 0.6), (1, 4, None, 0.2)], "g int, actor int, pred double, actual double")
    assert scoring.r_squared(df, ["g"]).first()["r2"] == pytest.approx(-0.0909090909)
    d = spark.createDataFrame([(1, k, x) for k, x in enumerate((0.05, 0.04, 0.06, 0.03, 0.05))], "g int, k int, delta double")
    assert scoring.paired_t(d, ["g"]).first()["t"] == pytest.approx(9.021342216)
    assert scoring.dm_hac(d, ["g"], "k", bandwidth=1).first()["t"] == pytest.approx(18.474044565)
    assert scoring.dm_hac(d, ["g"], "k", bandwidth=2).first()["t"] == pytest.approx(15.467586468)


def test_performance_fixture(spark):
    r = spark.createDataFrame([(1, k, x) for k, x in enumerate((0.1, -0.2, 0.05, 0.1))], "g int, quarter int, r double")
    p = portfolio.performance(r, ["g"]).first()
    assert (p["max_drawdown"], p["sharpe"], p["ann_return"]) == pytest.approx((0.2, 0.1740776560, 0.0164))
    none = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0)], "g int, quarter int, r double")
    assert portfolio.performance(none, ["g"]).first()["sharpe"] == 0


def test_turnover_and_coefficients(spark):
    h = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "d")], "quarter int, actor_id string")
    assert [r["turnover"] for r in portfolio.turnover(h).orderBy("quarter").collect()] == pytest.approx([1.0, 2 / 3])
    f = spark.createDataFrame([("A", "X", 3.0), ("B", "X", 1.0), ("A", "Y", 0.0)], "source string, target string, flow double")
    assert {(r["source"], r["coefficient"]) for r in flows.coefficients(f).collect()} == {("A", 0.75), ("B", 0.25)}


def test_weekly_tone_fixture(spark):
    rows = [("t", dt.date(2024, 1, 1), 2, 1.0, 10), ("t", dt.date(2024, 1, 2), 0, None, 10), ("t", dt.date(2024, 1, 3), 3, 2.0, 20)]
    w = flows.weekly(spark.createDataFrame(rows, "theme string, event_date date, article_count long, avg_tone double, total_docs_day long")).first()
    assert (w["article_count"], w["avg_tone"], w["intensity"]) == (5, pytest.approx(1.6), pytest.approx(0.125))


def obs(spark, rows):
    return pit.normalised(spark.createDataFrame([("k", "s", dt.datetime.fromisoformat(e), dt.datetime.fromisoformat(p), v, "x", "extra") for e, p, v in rows], "actor_id string, signal_id string, event_date timestamp_ntz, pub_date timestamp_ntz, value double, source string, form string"))


def test_pit_as_of(spark, tmp_path):
    o = obs(spark, [("2024-03-31", "2024-04-20", 1.0), ("2024-03-31", "2024-05-15", 2.0)])
    store = pit.PointInTimeStore(spark, str(tmp_path / "pit"))
    store.bulk_ingest([])
    store.ingest(o.limit(1))
    store.ingest(o.where("value = 2"))
    assert [r["value"] for r in store.query("2024-05-01").collect()] == [1.0] and [r["value"] for r in store.query("2024-06-01").collect()] == [2.0]
    assert store.query("2024-05-01", legacy=True).collect() == [] and [r[0] for r in store.list_sources().collect()] == ["x"]
    with pytest.raises(ValueError, match="pub_date"):
        pit.normalised(o.drop("pub_date"))


def test_pit_late_old_wins(spark):
    o = obs(spark, [("2024-06-30", "2024-07-10", 5.0), ("2024-03-31", "2024-08-01", 3.0), ("2024-06-30", "2024-10-01", 9.0)])
    ends = spark.sql("select date'2024-09-30' t union all select date'2024-01-01' union all select date'2024-10-01'")
    assert {r["period_end"].isoformat(): r["value"] for r in pit.as_of_panel(o, ends).collect()} == {"2024-09-30": 3.0, "2024-01-01": None, "2024-10-01": 9.0}


def test_read_boundary(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1)], "x double, n int"))
    assert df.first()["x"] is None
    with pytest.raises(ValueError, match="y"):
        assert_columns(df, ["x", "y"])


def test_mappers(spark):
    p = panel(spark, [(0.1, 0.2, 0.3)])
    r = N.MapperRegistry()
    assert r.intensity(p, 1, "bank").first()["intensity"] == pytest.approx(2 / 3) and len(r.registered_types()) == 12
    with pytest.raises(KeyError):
        r.intensity(p, 9, "bank")
    with pytest.raises(KeyError):
        r.get("martian")


def test_normal_quantile_and_cdf(spark):
    rows = spark.createDataFrame([(p,) for p in (0.005, 0.02, 0.3, 0.5, 0.9, 0.995)], "p double").select("p", N.normal_quantile(F.col("p")).alias("x"))
    for r in rows.withColumn("back", S.normal_cdf(F.col("x"))).collect():
        assert r["x"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-6) and r["back"] == pytest.approx(r["p"], abs=1e-6)


def simpson(f, low, high, steps=20_000):
    h = (high - low) / steps
    return h / 3 * math.fsum(f(low + k * h) * (1 if k in (0, steps) else 4 if k % 2 else 2) for k in range(steps + 1))


def t_p(t, df):
    """By the density in the angle, with the library's own gamma function."""
    front = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return front * simpson(lambda a: max(math.cos(a), 0.0) ** (df - 1), math.atan(abs(t) / math.sqrt(df)), math.pi / 2)


def test_t_tail_from_few_to_many_degrees(spark):
    rows = [(t, df) for df in (1, 2, 3, 5, 9, 30, 100, 999, 9999) for t in (0.0, 1e-5, 0.3, -1.0, 2.0, 3.5, -8.0, 40.0)]
    df = spark.createDataFrame([(float(t), n) for t, n in rows] + [(None, 3), (1.0, 0)], "t double, df long")
    got = df.select("t", "df", D.t_two_sided(F.col("t"), F.col("df")).alias("p"), D.t_tail(F.col("t"), F.col("df")).alias("q")).collect()
    for r in got[:-2]:
        want = t_p(r["t"], r["df"])
        assert r["p"] == pytest.approx(want, rel=1e-8, abs=1e-10)
        assert r["q"] == pytest.approx(want / 2 if r["t"] >= 0 else 1 - want / 2, abs=1e-9)
    assert [r["p"] for r in got[-2:]] == [None, None]


def test_f_and_binomial_tails(spark):
    df = spark.createDataFrame([(f, a, b) for f in (0.0, 0.2, 1.0, 4.0, 25.0) for a, b in ((1, 5), (3, 7), (2, 400), (40, 60))], "f double, a long, b long")
    for r in df.select("*", D.f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect():
        f, a, b = r["f"], r["a"], r["b"]
        x = a * f / (a * f + b)
        front = math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2))
        # u = s * s takes the density's pole at 0 away.
        assert r["p"] == pytest.approx(1 - front * simpson(lambda s, a=a, b=b: 2 * s ** (a - 1) * (1 - s * s) ** (b / 2 - 1), 0.0, math.sqrt(x)), abs=1e-8)
    # One numerator degree: the square of Student's t.
    one = spark.createDataFrame([(1.7, 12)], "t double, n long").select(D.f_tail(F.col("t") ** 2, F.lit(1), F.col("n")).alias("f"), D.t_two_sided(F.col("t"), F.col("n")).alias("t")).first()
    assert one["f"] == pytest.approx(one["t"], rel=1e-12)
    hits = spark.createDataFrame([(k, 12) for k in range(-1, 14)], "k long, n long").select("k", D.binomial_tail(F.col("k"), F.col("n"), 0.3).alias("p")).collect()
    for r in hits:
        assert r["p"] == pytest.approx(sum(math.comb(12, j) * 0.3**j * 0.7 ** (12 - j) for j in range(max(r["k"], 0), 13)), abs=1e-12)


def test_p_of_few_differences(spark):
    rows = [(g, k, x) for g, xs in {"a": (0.05, 0.04, 0.06, 0.03, 0.05), "b": (0.1, 0.1, 0.1), "c": (1.0, 2.0), "d": (0.5,)}.items() for k, x in enumerate(xs)]
    d = spark.createDataFrame(rows, "g string, k int, delta double")
    t = {r["g"]: r for r in scoring.paired_t(d, ["g"]).collect()}
    assert t["a"]["p"] == pytest.approx(t_p(9.021342216, 4), rel=1e-7) and t["b"]["p"] is t["c"]["p"] is t["d"]["p"] is None
    hac = {r["g"]: r for r in scoring.dm_hac(d, ["g"], "k").collect()}
    assert hac["a"]["p"] == pytest.approx(t_p(18.474044565, 4), rel=1e-6) and hac["d"]["p"] is None
    dm = {r["g"]: r for r in scoring.dm_test(d.withColumn("z", F.lit(0.0)), ["g"], "delta", "z").collect()}
    assert dm["d"]["p"] == dm["b"]["p"] == 1.0 and dm["a"]["p"] == pytest.approx(t_p(dm["a"]["dm"], 4), rel=1e-7)
    r = spark.createDataFrame([(0.5, 10), (1.0, 10), (0.1, 2), (None, 9)], "r double, n long").select(studies.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert r[0]["p"] == pytest.approx(t_p(0.5 * math.sqrt(8 / 0.75), 8), rel=1e-8) and [x["p"] for x in r[1:]] == [0.0, None, None]
