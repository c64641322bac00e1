"""Session settings that the panel semantics rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def session(name: str = "panelloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; master and memory are the deployment's business."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The run's folder in the one that driver and executors share (spark.checkpoint.dir); whoever owns that may clear it after the run.

    Where it is unset, a local session gets a new folder of the machine; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/panelloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, alike for all that read it, and not again when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: (application, source, what lies there, name) -> where the table lies, and its schema.
_KEPT: dict[tuple[str, str, int, str], tuple[str, StructType]] = {}


def _state(spark: SparkSession, source: str) -> int:
    """A number of the names, lengths and times of what lies in a folder: it changes when a table there is written anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return hash(tuple(sorted((e.getPath().getName(), e.getLen(), e.getModificationTime()) for e in entries)))


def kept(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries start from, written once an application and source, and read by all that follow until the source is written anew."""
    key = (spark.sparkContext.applicationId, source, _state(spark, source), name)
    if key not in _KEPT:
        df, path = build(), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _KEPT[key] = path, df.schema
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)
