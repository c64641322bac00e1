from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelloom import session
from panelloom.operators import european
from panelloom.plans import european_queries
from panelloom.sources import payloads

Q = [dt.date(2010 + k // 4, 3 * (k % 4) + 1, 1) for k in range(6)]


def test_firm_values_are_a_quarter_old_at_most(spark):
    rows = [("a", "X", "BS", dt.date(2010, 1, 5), 100.0, None), ("a", "X", "BS", dt.date(2010, 3, 5), 200.0, None), ("a", "X", "CF", dt.date(2010, 2, 1), None, -20.0), ("a", "X", "CF", dt.date(2010, 4, 1), None, -900.0)]
    rows += [("b", "X", "BS", dt.date(2010, 1, 1), -5.0, None), ("b", "X", "CF", dt.date(2010, 1, 1), None, 1.0), ("c", "Y", "BS", dt.date(2010, 2, 1), 10.0, 7.0), ("c", "Y", "CF", dt.date(2010, 2, 1), 9.0, 5.0)]
    df = spark.createDataFrame(rows, "ticker string, exchange string, statement string, date date, total_assets double, capex double")
    got = {(r["actor"], Q.index(r["period"])): r["intensity"] for r in european.firm_intensities(df, Q[0], Q[-1]).collect()}
    assert got == {("a.X", 0): 0.5, ("c.Y", 0): 1.0, ("a.X", 1): 1.0, ("c.Y", 1): 0.5}


def test_series_of_actors(spark):
    s = spark.createDataFrame([("s", dt.date(2010, 2, 1), 4.0), ("s", dt.date(2010, 3, 1), 2.0), ("s", dt.date(2010, 8, 1), 6.0), ("flat", dt.date(2010, 1, 1), 1.0)], "source string, date date, value double")
    a = spark.createDataFrame([("x", "s", "level"), ("y", "s", "cumulative_change"), ("z", "flat", "level"), ("none", "t", "level")], "actor string, source string, transform string")
    got = {(r["actor"], Q.index(r["period"])): r["intensity"] for r in european.series_intensities(s, a, Q[0], Q[-1], "m").collect()}
    assert got == {(k, q): float(q >= 2) for k in "xy" for q in range(6)}


def test_readiness(spark):
    plan = spark.createDataFrame([("e", "r1", ["i1", "i2"], ["fred"]), ("f", "r9", [], []), ("g", None, ["i1"], ["x", "fred"])], "experiment string, registry string, intensities array<string>, sources array<string>")
    present = spark.createDataFrame([("registry", "r1"), ("intensities", "i2"), ("source", "fred"), ("source", "fred"), ("source", "r9")], "kind string, name string")
    got = {(r["experiment"], r["check"]): r["ready"] for r in european.readiness(plan, present).collect()}
    assert got == {("e", "registry"): True, ("e", "intensities"): True, ("e", "source fred"): True, ("f", "registry"): False, ("f", "intensities"): True, ("g", "registry"): False, ("g", "intensities"): False, ("g", "source x"): False, ("g", "source fred"): True}


def test_sdmx_csv_headers(spark):
    texts = ['OBS_VALUE,"TIME_PERIOD"\r\n1.5,2020\r\n,2021\r\nNaN,2022\r\nx,2023\r\n2,\r\n', "TIME_PERIOD,X\n2020,1", "", None, '"A, b",TIME_PERIOD,OBS_VALUE\n"p, ""q""",2020-Q1,7\n']
    raw = spark.createDataFrame(list(enumerate(texts)), "k int, payload string")
    assert sorted((r["k"], r["period"], r["value"]) for r in payloads.sdmx_csv(raw, ["k"]).collect()) == [(0, "2020", 1.5), (4, "2020-Q1", 7.0)]


def test_kept_tables_follow_their_source(spark, tmp_path):
    read = lambda: session.kept(spark, str(tmp_path), "doubled", lambda: spark.read.parquet(f"{tmp_path}/t").select((F.col("id") * 2).alias("x")))
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/t")
    first = read()
    assert first.agg(F.sum("x")).first()[0] == 6 and read().inputFiles() == first.inputFiles()
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert read().agg(F.sum("x")).first()[0] == 20
    with pytest.raises(Exception, match="nowhere"):
        session.kept(spark, f"{tmp_path}/nowhere", "x", lambda: spark.range(1))


def test_cents_of_ties_are_rounded_as_in_sql(spark):
    x = spark.createDataFrame([(268.775, 1384.0049999999999)], "a double, b double")
    assert tuple(x.select(european_queries._cents(F.col("a")), european_queries._cents(F.col("b"))).first()) == (268.77, 1384.01)


def test_assets_without_spending_have_no_rank(spark):
    df = spark.createDataFrame([("a", "X", "BS", Q[0], 100.0, None), ("b", "X", "BS", Q[0], 100.0, None), ("b", "X", "CF", Q[0], None, 5.0)], "ticker string, exchange string, statement string, date date, total_assets double, capex double")
    assert {r["actor"] for r in european.firm_intensities(df, Q[0], Q[0]).collect()} == {"b.X"}
