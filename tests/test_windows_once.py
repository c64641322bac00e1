from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelloom.operators import scoring, windows

QUARTERS = [dt.date(2000 + k // 4, 3 * (k % 4) + 1, 1) for k in range(8)]


def test_windows_are_cut_where_an_actors_quarters_lie(spark):
    panel = spark.createDataFrame([(a, q, None if a == 3 and q.year == 2001 else float(a + k)) for a in range(6) for k, q in enumerate(QUARTERS) if (a, k) != (0, 5)], "actor long, period date, value double")
    w = windows.windows(panel, [2001], 1)
    assert "Join LeftOuter" not in w._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["actor"], r["period"]): (r["value"], r["train"]) for r in w.collect()}
    assert len(got) == 48 and got[3, QUARTERS[5]] == (4.5, False) and got[0, QUARTERS[5]][0] == sum([0, 1, 2, 3, 4, 6, 7]) / 7
    left = {(r["actor"], r["period"]): r["value"] for r in windows.windows(panel, [2001], 1, impute="train").collect()}
    assert left[0, QUARTERS[5]] == 1.5


def test_scores_need_no_window_over_a_group(spark):
    p = spark.createDataFrame([("a", 1.0, 1.5), ("a", 2.0, 2.0), ("a", 4.0, 3.0), ("b", 1.0, 3.0), ("b", 1.0, 1.0)], "g string, actual double, pred double")
    s = scoring.r_squared(p, ["g"])
    assert "Window" not in s._jdf.queryExecution().optimizedPlan().toString()
    assert {r["g"]: (round(r["r2"], 9), r["mae"], r["n"]) for r in s.collect()} == {"a": (round(1 - 1.25 / (14 / 3), 9), 0.5, 3), "b": (0.0, 1.0, 2)}
