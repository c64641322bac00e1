from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from panelloom.operators import pit

SCHEMA = "actor_id string, signal_id string, event_date timestamp_ntz, pub_date timestamp_ntz, value double, source string"


def frame(spark, rows, **more):
    day = lambda s: s and dt.datetime.fromisoformat(s)
    df = spark.createDataFrame([(a, "s", day(e), day(p), v, src) for a, e, p, v, src in rows], SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def files(root):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def held(store):
    return sorted(((r["actor_id"], r["event_date"] and r["event_date"].date().isoformat(), r["pub_date"] and r["pub_date"].date().isoformat(), r["value"], r["source"]) for r in store.table().collect()), key=str)


FIRST = [("a", "2020-03-31", "2020-05-01", 1.0, "x"), ("a", "2020-03-31", "2021-02-01", 2.0, "x"), ("b", "2020-03-31", "2022-01-01", 3.0, "x"), ("b", "2020-03-31", "2022-01-01", 3.0, "y")]


def test_ingesting_twice_changes_nothing(spark, tmp_path):
    store = pit.PointInTimeStore(spark, str(tmp_path / "pit"))
    store.ingest(frame(spark, FIRST))
    once = held(store)
    store.ingest(frame(spark, FIRST + FIRST))
    assert held(store) == once and len(once) == 4


def test_only_touched_folders_are_written(spark, tmp_path):
    store = pit.PointInTimeStore(spark, str(tmp_path / "pit"))
    store.ingest(frame(spark, FIRST))
    before = files(store.root)
    store.ingest(frame(spark, [("b", "2020-03-31", "2022-01-01", 30.0, "x"), ("c", "2020-03-31", "2022-07-01", 4.0, "x")]))
    after = files(store.root)
    kept = {f for f in before if "source=x/published=2022" not in f}
    assert len(kept) == 3 and all(after.get(f) == before[f] for f in kept)
    assert sorted(r[3] for r in held(store)) == [1.0, 2.0, 3.0, 4.0, 30.0]


def test_later_years_are_not_read(spark, tmp_path):
    store = pit.PointInTimeStore(spark, str(tmp_path / "pit"))
    store.ingest(frame(spark, FIRST))
    early = store.query("2021-12-31", sources=["x"])
    plan = early._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.split("PartitionFilters:")[1:])
    assert "published" in filters and "source" in filters.split("PushedFilters")[0]
    assert "pub_date" in plan.split("PushedFilters:")[1]
    assert [(r["actor_id"], r["value"]) for r in early.collect()] == [("a", 2.0)]
    # The folders of later years hold what no reader could read: they aren't opened.
    for f in files(store.root):
        if "published=2022" in f:
            with open(f, "wb") as broken:
                broken.write(b"not parquet")
            os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    schema = spark.read.schema("actor_id string, signal_id string, event_date timestamp_ntz, pub_date timestamp_ntz, value double, vintage_id string, source string, published int")
    rows = schema.parquet(store.root).where("published <= 2021 AND source = 'x'").collect()
    assert len(rows) == 2
    with pytest.raises(Exception, match="parquet"):
        schema.parquet(store.root).collect()


def test_nulls_and_more_columns(spark, tmp_path):
    store = pit.PointInTimeStore(spark, str(tmp_path / "pit"))
    odd = [("a", None, None, 1.0, "x"), (None, "2020-01-01", "2020-02-01", None, "x"), ("a", "2020-01-01", None, 2.0, None)]
    store.ingest(frame(spark, odd))
    store.ingest(frame(spark, odd + FIRST, form="10-K"))
    assert len(held(store)) == 7 and "form" in store.table().columns
    assert {r["form"] for r in store.table().collect()} == {"10-K"}
    store.ingest(frame(spark, []))
    assert len(held(store)) == 7
    assert sorted(r[0] for r in store.list_actors().collect()) == ["a", "b"]


def test_new_rows_and_greater_values_win(spark, tmp_path):
    store = pit.PointInTimeStore(spark, str(tmp_path / "pit"))
    store.append(frame(spark, [("a", "2020-01-01", "2020-02-01", 9.0, "x")]))
    store.append(frame(spark, [("a", "2020-01-01", "2020-02-01", 9.0, "x")]))
    assert len(held(store)) == 2
    store.ingest(frame(spark, [("a", "2020-01-01", "2020-02-01", 5.0, "x"), ("a", "2020-01-01", "2020-02-01", 7.0, "x")]))
    assert [r[3] for r in held(store)] == [7.0]


def test_snapshot_holds_one_row_a_key(spark, tmp_path):
    store = pit.PointInTimeStore(spark, str(tmp_path / "pit"))
    store.ingest(frame(spark, FIRST))
    store.snapshot(str(tmp_path / "now"))
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "now")).collect()) == [2.0, 3.0, 3.0]
    store.snapshot(str(tmp_path / "then"), "2020-12-31")
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "then")).collect()] == [1.0]
