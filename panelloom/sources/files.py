"""Text and column files with a schema of their own: CSV with a header, JSON lines, Parquet; metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Quotes are doubled inside quotes, and a quoted value may go over several lines.
_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "nullValue": "", "emptyValue": '""'}


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """``df`` as a folder of files, one a partition."""
    options = {k: v for k, v in _CSV.items() if k != "multiLine"} if kind == "csv" else {}
    df.write.mode(mode).format(kind).options(**options).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: StructType | str) -> DataFrame:
    """Files of a known schema; nothing is inferred, so no extra pass. CSV columns go by their header's names."""
    reader = spark.read.format(kind).schema(schema)
    return reader.options(**_CSV, enforceSchema=False).load(path) if kind == "csv" else reader.load(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON line a row, in one file: metrics are a few dozen rows."""
    metrics.repartition(1).write.mode("overwrite").json(path)
