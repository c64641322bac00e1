from __future__ import annotations

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from panelloom.operators import universe as U
from panelloom.sources import archives, files
from panelloom.sources import payloads as P
from panelloom.streaming import jobs


def raw(spark, *bodies):
    return spark.createDataFrame([(f"k{i}", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "key string, payload string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_numbers_and_periods(spark):
    df = spark.createDataFrame([("1,234.5",), (".",), ("None",), ("---",), ("-2",), (None,)], "t string").select(P.number(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [1234.5, None, None, None, -2.0, None]
    dates = spark.createDataFrame([("2005-Q3",), ("2005Q1",), ("2005-07",), ("2005",), ("2005-02-03",), ("x",)], "t string").select(P.period_start(F.col("t")).alias("d"))
    assert [r["d"] and r["d"].isoformat() for r in dates.collect()] == ["2005-07-01", "2005-01-01", "2005-07-01", "2005-01-01", "2005-02-03", None]


def test_company_facts(spark):
    o = lambda end, filed, val, form: {"end": end, "filed": filed, "val": val, "form": form, "fp": "Q1", "fy": 2020}
    body = {"facts": {"us-gaap": {"Assets": {"units": {"USD": [o("2020-03-31", "2020-05-01", 5, "10-Q"), o("2020-03-31", None, 5, "10-Q"), o("2020-03-31", "2020-05-01", 7, "8-K")]}}, "Other": {"units": {"USD": [o("2020-03-31", "2020-05-01", 1, "10-K")]}}}}}
    facts = P.company_facts(raw(spark, body, "{}", "broken"), ["key"])
    assert rows(facts, "key", "tag", "value", "period") == [("k0", "Assets", 5.0, "2020Q1"), ("k0", "Other", 1.0, "2020Q1")]
    assert rows(P.first_tag(facts, ["key"], ["Missing", "Other", "Assets"]), "tag") == [("Other",)]


def test_macro_payloads(spark):
    fred = {"observations": [{"date": "2020-01-01", "value": "1.5", "realtime_start": "2020-02-01"}, {"date": "2020-02-01", "value": "."}]}
    assert rows(P.observations(raw(spark, fred), ["key"]), "value", "pub_date") == [(1.5, dt.date(2020, 2, 1))]
    bea = {"BEAAPI": {"Results": [{"Data": [{"RowCode": "A", "ColCode": "B", "Year": "2012", "DataValue": "1,000"}, {"RowCode": "A", "ColCode": "C", "Year": "2012", "DataValue": "---"}]}]}}
    assert rows(P.table_rows(raw(spark, bea), ["key"]), "source", "target", "year", "flow") == [("A", "B", 2012, 1000.0)]
    imf = {"values": {"GDP": {"US": {"2020": 1.0, "2021": 2.0}}}}
    assert rows(P.nested_years(raw(spark, imf), ["key"]), "indicator", "country", "year", "value") == [("GDP", "US", 2020, 1.0), ("GDP", "US", 2021, 2.0)]


def test_sdmx(spark):
    body = {"data": {"structures": [{"dimensions": {"series": [{"id": "AREA", "values": [{"id": "US"}, {"id": "DE"}]}, {"id": "FREQ", "values": [{"id": "Q"}]}], "observation": [{"id": "T", "values": [{"id": "2020-Q1"}, {"id": "2020-Q2"}]}]}}], "dataSets": [{"series": {"0:0": {"observations": {"0": [1.5], "1": [2.5]}}, "1:0": {"observations": {"1": [9.0]}}}}]}}
    out = P.sdmx_series(raw(spark, body), ["key"], {"AREA": ["US"], "ABSENT": ["x"]})
    assert rows(out.select(F.col("dims")["AREA"].alias("a"), "period", "value"), "a", "period", "value") == [("US", "2020-Q1", 1.5), ("US", "2020-Q2", 2.5)]
    one = {"CompactData": {"DataSet": {"Series": {"@REF_AREA": "US", "@INDICATOR": "I", "Obs": {"@TIME_PERIOD": "2020", "@OBS_VALUE": "3"}}}}}
    many = {"CompactData": {"DataSet": {"Series": [{"@REF_AREA": "DE", "@INDICATOR": "I", "Obs": [{"@TIME_PERIOD": "2020", "@OBS_VALUE": "4"}, {"@TIME_PERIOD": "2021"}]}, {"@REF_AREA": "FR", "@INDICATOR": "I"}]}}}
    assert rows(P.sdmx_compact(raw(spark, one, many, "{}"), ["key"]), "area", "period", "value") == [("DE", "2020", 4.0), ("US", "2020", 3.0)]


def test_statements(spark):
    body = {"Financials": {"Balance_Sheet": {"quarterly": {"2020-03-31": {"filing_date": "2020-05-01", "currency_symbol": "EUR", "totalAssets": "5", "cash": "None"}}}, "Cash_Flow": {"quarterly": {"2020-03-31": {"capex": "-2"}}}}}
    out = P.statements(raw(spark, body), ["key"], ["totalAssets", "cash", "capex"])
    assert rows(out, "statement", "date", "totalAssets", "cash", "capex") == [("BS", "2020-03-31", 5.0, None, None), ("CF", "2020-03-31", None, None, -2.0)]


def test_news_and_lists(spark):
    line = "\t".join(["x"] * 4 + ["id1"] + ["x"] * 3 + ["TAX,1;WAR,2;TAX,9;"] + ["x"] * 5 + ["Acme Corp,3"] + ["-1.5,2,3"])
    out = P.knowledge_graph(spark.createDataFrame([(line,), (line,), ("short\tline",)], "value string")).collect()
    assert [(r["doc_id"], r["themes"], r["orgs"], r["tone"]) for r in out] == [("id1", ["tax", "war"], ["acme corp"], -1.5)]
    wide = spark.createDataFrame([(1, 2.0, None)], "date int, A double, B double")
    assert rows(P.long_prices(wide), "ticker", "close") == [("A", 2.0)]
    assert P.renamed_by_synonym(wide, {"ticker": ["a"]}).columns == ["ticker"]
    with pytest.raises(ValueError, match="isin"):
        P.renamed_by_synonym(wide, {"isin": ["code"]})
    lines = spark.createDataFrame([(0, "junk"), (1, "Ticker,Name"), (2, "X,Y")], "line int, value string")
    assert rows(P.after_header(lines), "line") == [(1,), (2,)]
    slots = spark.createDataFrame([(1, 700), (1, 740), (1, 100), (2, 5)], "day int, minute int")
    assert rows(P.nearest_slot(slots, "day", "minute"), "day", "minute") == [(1, 700), (2, 5)]


def test_registry_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.json")
    a = spark.createDataFrame([(0, "x", "X", "bank", 2, "US", "fin", {"cik": "1"}), (1, "y", "Y", "sme", 2, "US", "tech", {})], "position int, actor_id string, name string, actor_type string, layer int, geography string, sector string, external_ids map<string,string>")
    U.write_registry(a, path, version=1)
    back = U.read_registry(spark, path)
    assert rows(back, "position", "actor_id", "layer") == [(0, "x", 2), (1, "y", 2)] and U.of_type(back, "bank").first()["external_ids"] == {"cik": "1"}
    assert U.taxonomy_actors("text\n```yaml\nactors:\n  - actor_id: a\n    layer: 1\n  - actor_id: 'b'\n```") == [{"actor_id": "a", "layer": "1"}, {"actor_id": "b"}]
    with pytest.raises(ValueError):
        U.taxonomy_actors("nothing")


def test_zip_members_and_metrics(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("a.tsv", f"one\t{k}\r\ntwo\n")
            z.writestr("empty.tsv", "")
    found = archives.lines(archives.members(spark, str(tmp_path / "*.zip")))
    assert rows(found, "member", "line", "text") == [("a.tsv", 0, "one\t0"), ("a.tsv", 0, "one\t1"), ("a.tsv", 1, "two"), ("a.tsv", 1, "two")]
    files.write_metrics(spark.createDataFrame([("r2", 0.5)], "name string, value double"), str(tmp_path / "m"))
    assert rows(files.read(spark, str(tmp_path / "m"), "json", "name string, value double"), "name", "value") == [("r2", 0.5)]


def test_capped_selection(spark):
    firms = spark.createDataFrame([(k, float(k), "a" if k < 6 else "b") for k in range(10)], "actor long, place__ double, sector string")
    got = {r["actor"]: r["filled"] for r in U.capped_selection(firms, 6, ["place__"], {"sector": 0.35}).collect()}
    assert got == {0: False, 1: False, 6: False, 7: False, 2: True, 3: True}


def test_stratified_sample_is_exact(spark):
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 70, "a").when(F.col("id") < 99, "b").otherwise("c"))
    n = {r["g"]: r["count"] for r in U.stratified_sample(df, "g", "id", 10).groupBy("g").count().collect()}
    assert sum(n.values()) == 10 and n["c"] == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = tmp_path / "events"
    events.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = jobs.weekly_tone(stream, late="60 days").writeStream.format("memory").queryName("weekly").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = jobs.weekly_tone(events)
    seen = lambda df: sorted((r["event_type"], r["week_start"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert seen(spark.table("weekly")) == seen(want)


def test_online_filter_equals_one_pass(spark, tmp_path):
    from panelloom.functions.kernels import Kalman
    import numpy as np

    values = [0.3, 0.1, -0.4, 0.9, 0.2, 0.5]
    for part in range(2):
        spark.createDataFrame([(a, part * 3 + t, v) for a in (1, 2) for t, v in enumerate(values[part * 3 : part * 3 + 3])], "actor long, period int, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema("actor long, period int, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    with jobs.state_by_value(spark):
        q = jobs.online_filter(stream).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    filt = Kalman(np.array([[0.9]]), np.array([[1.0]]), 0.1)
    want = filt.run(np.array(values)[:, None])[:, 0].tolist()
    got = [r["predicted"] for r in spark.table("online").where("actor = 1").orderBy("step").collect()]
    assert got == pytest.approx(want)


def test_streamed_weeks_keep_the_last_row_and_state_over_a_restart(spark, tmp_path):
    events, out = str(tmp_path / "events"), str(tmp_path / "out")
    day = lambda n: dt.datetime(2024, 1, n)
    schema = "event_type string, ts timestamp, value double"
    for rows in ([("a", day(1), 1.0), ("a", day(2), 2.0), ("b", day(3), 5.0)], [("a", day(4), 4.0), ("a", day(9), 8.0), ("b", day(9), None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(events)
        jobs.put_available(jobs.weekly_tone(spark.readStream.schema(schema).parquet(events)), out, str(tmp_path / "c3"), "update")
    put = spark.read.parquet(out)
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 8)
    assert sorted(r["total"] for r in put.where("event_type = 'a' and week_start = '2024-01-01'").collect()) == [3.0, 7.0]
    assert rows_of(jobs.latest(put, ["event_type", "week_start"])) == [("a", first, 3, 7.0), ("a", second, 1, 8.0), ("b", first, 1, 5.0), ("b", second, 1, None)]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("event_type", "week_start", "n", "total").collect()), key=str)


def test_filters_of_many_actors_share_state_rows(spark, tmp_path):
    """A call of the state function holds a block of actors: 3,000 of them, in a batch each for old and new ones, keep at most 1,024 rows of state."""
    import numpy as np

    from panelloom.functions.kernels import Kalman

    schema, arriving = "actor long, period int, value double", str(tmp_path / "rows")
    value = lambda a, t: ((a * 7 + t * 13) % 100) / 100
    for part, (first, last) in enumerate(((0, 2000), (1000, 3000))):
        spark.createDataFrame([(a, part * 2 + t, value(a, part * 2 + t)) for t in (1, 0) for a in range(first, last)], schema).coalesce(1).write.mode("append").parquet(arriving)
        with jobs.state_by_value(spark):
            q = jobs.online_filter(spark.readStream.schema(schema).parquet(arriving)).writeStream.foreachBatch(lambda b, n: b.write.parquet(str(tmp_path / f"out/batch={n}"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024
    got = {(r["actor"], r["step"]): r["predicted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 8000
    for a, periods in ((0, (0, 1)), (1500, (0, 1, 2, 3)), (2999, (2, 3))):
        want = Kalman(np.array([[0.9]]), np.array([[1.0]]), 0.1).run(np.array([[value(a, t)] for t in periods]))[:, 0]
        assert [got[a, k + 1] for k in range(len(periods))] == pytest.approx(want.tolist())


def test_streamed_filter_takes_rows_without_a_quarter_last_and_none_without_an_actor(spark, tmp_path):
    import duckdb

    from panelloom.plans import registry

    day = lambda y, m: dt.datetime(y, m, 1)
    lines = [(1, day(1995, 1), 10.0, 0.3), (1, day(1997, 1), 10.0, 0.1), (1, None, 10.0, 0.5), (1, day(1999, 1), None, 0.2), (1, day(2001, 1), 10.0, 0.4), (2, None, 10.0, 0.2), (None, day(1995, 1), 10.0, 0.2)]
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [tuple(r) for r in registry.QUERIES["streamed_filter"](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.sql(registry.ORACLE_SQL["streamed_filter"]).fetchall()
    assert len(want) == 6 and sorted(got, key=str) == sorted(want, key=str)
