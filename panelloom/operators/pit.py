"""Point-in-time store: bitemporal observations, queried as of a date.

All vintages stay; which one counts is decided when reading. ``legacy`` reading keeps one row a key regardless of
the date asked for. Files lie by source and year of publication, so that ingesting touches only the years that new
rows were published in, and a query as of a date never opens later ones.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.schema import PIT, assert_columns
from panelloom.session import shared_dir

KEY = ["actor_id", "signal_id", "event_date", "source"]
REQUIRED = [f.name for f in PIT if f.name != "vintage_id"]


def normalised(obs: DataFrame) -> DataFrame:
    """Canonical columns first, with their types; a missing vintage_id is null; extra columns follow."""
    assert_columns(obs, REQUIRED)
    if "vintage_id" not in obs.columns:
        obs = obs.withColumn("vintage_id", F.lit(None).cast("string"))
    extra = [c for c in obs.columns if c not in PIT.fieldNames()]
    return obs.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PIT), *extra)


def latest(obs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Of each key, the row published last (ties: the greater value)."""
    w = Window.partitionBy(*key).orderBy(F.col("pub_date").desc_nulls_last(), F.col("value").desc_nulls_last())
    return obs.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


#: Files' folders: rows without a date of publication lie in one of their own.
_FOLDERS = ["source", "published"]


def _year(pub_date: Column) -> Column:
    return F.year(pub_date).alias("published")


class PointInTimeStore:
    """Parquet files under ``root``, one row for each key and publication."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def append(self, obs: DataFrame) -> None:
        """Adds rows as they are: for rows that can't be there yet. ``ingest`` later tidies what repeats."""
        self._write(normalised(obs).withColumn("published", _year(F.col("pub_date"))), "append")

    def ingest(self, obs: DataFrame) -> None:
        """Adds rows; a row of a key and publication that is there already takes the old one's place, so that ingesting twice changes nothing.

        Folders (source, year of publication) without a new row are neither read nor written. Of new rows alike in key and publication the greater
        value stays. What replaces a folder is written to the shared folder first and is whole there if the run ends in between. One writer at a time.
        """
        new = normalised(obs).withColumn("published", _year(F.col("pub_date"))).withColumn("__new", F.lit(1))
        staged = f"{shared_dir(self.spark)}/store-{uuid.uuid4().hex}"
        if self._there():
            new.write.parquet(f"{staged}/new")
            new = self.spark.read.parquet(f"{staged}/new")
            touched = new.select(*_FOLDERS).distinct().alias("t")
            old = self._files().alias("o")
            same = F.col("o.source").eqNullSafe(F.col("t.source")) & F.col("o.published").eqNullSafe(F.col("t.published"))
            new = old.join(touched, same, "left_semi").withColumn("__new", F.lit(0)).unionByName(new, allowMissingColumns=True)
        one = Window.partitionBy(*KEY, "pub_date").orderBy(F.col("__new").desc(), F.col("value").desc_nulls_last())
        merged = new.withColumn("__k", F.row_number().over(one)).where("__k = 1").drop("__k", "__new")
        order = [*_FOLDERS, "actor_id", "signal_id", "event_date", "pub_date"]
        # A file holds a range of keys in order, so that a reader of few keys skips the other files' row groups.
        merged.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{staged}/merged")
        self._write(self.spark.read.parquet(f"{staged}/merged"), "overwrite")

    def bulk_ingest(self, frames: list[DataFrame]) -> None:
        """Several frames in one pass; a column that some lack is null there."""
        if frames:
            self.ingest(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))

    def snapshot(self, path: str, as_of=None) -> None:
        """Writes each key's row as of a date (None: the last one) as a table of its own, for readers that always ask for the same."""
        found = self.query(as_of)
        found.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.mode("overwrite").partitionBy("source").parquet(path)

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*_FOLDERS).parquet(self.root)

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _files(self) -> DataFrame:
        """All rows with their folder's year; a frame with columns that others lack is read as well."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.root)
        return normalised(rows).withColumn("published", F.col("published").cast("int"))

    def table(self) -> DataFrame:
        return self._files().drop("published")

    def query(self, as_of=None, sources=None, actor_ids=None, signal_ids=None, date_range=None, legacy: bool = False) -> DataFrame:
        """As ``pit.query``; folders of later publications are not read, unless ``legacy`` needs every key's last one."""
        rows = self._files()
        if as_of is not None and not legacy and not isinstance(as_of, Column):
            rows = rows.where(F.col("published") <= F.year(F.lit(as_of).cast("timestamp_ntz")))
        return query(rows.drop("published"), as_of, sources, actor_ids, signal_ids, date_range, legacy)

    def query_signals(self, signal_ids: list[str], **more) -> DataFrame:
        return self.query(signal_ids=signal_ids, **more)

    def query_intensity(self, actor_ids: str | list[str], **more) -> DataFrame:
        return self.query(actor_ids=[actor_ids] if isinstance(actor_ids, str) else actor_ids, **more)

    def list_actors(self) -> DataFrame:
        return catalogue(self.table(), "actor_id")

    def list_signals(self) -> DataFrame:
        return catalogue(self.table(), "signal_id")

    def list_sources(self) -> DataFrame:
        return catalogue(self.table(), "source")


def _in(column: str, values) -> Column:
    return F.lit(True) if values is None else F.col(column).isin(list(values))


def query(obs: DataFrame, as_of=None, sources=None, actor_ids=None, signal_ids=None, date_range=None, legacy: bool = False) -> DataFrame:
    """Each key's last row published by ``as_of`` (a date, timestamp, string or column), within the filters; both ends of ``date_range`` count.

    The filters are on stored columns and reach the scan. ``legacy`` keeps the last row of each key first, as a
    store that overwrites vintages would, so that an ``as_of`` before the last revision finds nothing.
    """
    if legacy:
        obs = latest(obs)
    wanted = _in("source", sources) & _in("actor_id", actor_ids) & _in("signal_id", signal_ids)
    if as_of is not None:
        wanted = wanted & (F.col("pub_date") <= (as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")))
    if date_range is not None:
        wanted = wanted & F.col("event_date").between(*(F.lit(d).cast("timestamp_ntz") for d in date_range))
    found = obs.where(wanted)
    return found if legacy else latest(found)


def catalogue(obs: DataFrame, column: str) -> DataFrame:
    return obs.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def leaks(obs: DataFrame) -> DataFrame:
    """Rows published before they happened."""
    return obs.where("pub_date < event_date")


def as_of_panel(obs: DataFrame, period_ends: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """At each end in ``period_ends`` (column t), each key's value with the last (pub_date, event_date) by then.

    Rows and ends go into one sequence a key, and the last known value is carried on: one sort, and no row
    meets more than its own key. A publication dated on an end counts. Keys without one by then have a null.
    """
    keys = keys or ["actor_id"]
    rows = obs.select(*keys, F.col("pub_date").cast("timestamp_ntz").alias("t"), F.lit(0).alias("grid"), F.col("event_date"), F.col("value"))
    ends = obs.select(*keys).distinct().crossJoin(period_ends.select(F.col("t").cast("timestamp_ntz").alias("t")))
    both = rows.unionByName(ends.withColumn("grid", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("t", "grid", "event_date", "value").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("known", F.last("value", ignorenulls=True).over(order)).where("grid = 1").select(*keys, F.col("t").cast("date").alias("period_end"), F.col("known").alias("value"))


def on_union_of_calendars(obs: DataFrame, calendar: DataFrame, keys: list[str], time: str = "t", value: str = "value") -> DataFrame:
    """(*keys, time, value, observed, asked): each key's last known value on every date of its observations or of its own ``calendar`` (*keys, time).

    Keys may have calendars of different dates, or be in one table only: without an observation by then the value is null. Of several values of a
    date the greatest counts. One sort a key; dates of other keys are never met.
    """
    seen = obs.select(*keys, time, F.col(value).alias("v__"), F.lit(True).alias("o__"), F.lit(False).alias("c__"))
    asked = calendar.select(*keys, time, F.lit(None).cast(obs.schema[value].dataType).alias("v__"), F.lit(False).alias("o__"), F.lit(True).alias("c__"))
    dates = seen.unionByName(asked).groupBy(*keys, time).agg(F.max("v__").alias("v__"), F.max("o__").alias("observed"), F.max("c__").alias("asked"))
    past = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return dates.select(*keys, time, F.last("v__", ignorenulls=True).over(past).alias(value), "observed", "asked")


#: Days from an event to its publication.
LAGS = {"fred": 30, "news_weekly": 7, "io_tables": 548, "weo": 365, "oecd_monthly": 45, "oecd_quarterly": 75, "ifs_monthly": 30, "ifs_quarterly": 90}


def with_publication_lag(obs: DataFrame, family: str = "family", lags: dict[str, int] | None = None) -> DataFrame:
    """pub_date where it is null: event_date plus the family's days; families without a lag stay null."""
    days = F.lit(None).cast("int")
    for name, n in (lags or LAGS).items():
        days = F.when(F.col(family) == name, F.lit(n)).otherwise(days)
    return obs.withColumn("pub_date", F.coalesce("pub_date", F.date_add(F.col("event_date").cast("date"), days).cast("timestamp_ntz")))


def merge_vintages(current: DataFrame, vintages: DataFrame, key: str = "signal_id") -> DataFrame:
    """Vintage series, and current ones of those that have no vintages."""
    return current.join(vintages.select(key).distinct(), key, "left_anti").unionByName(vintages, allowMissingColumns=True)
