"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and \t \n \v \f \r, nothing else.
SPACE = r"\x20\x09-\x0D"
#: Elements of a long array that are worked through at a time where a running value is wanted.
_STRIDE = 128
#: Code points of a text's pieces where parts of it are cut out.
_PIECE = 1024


def shared_dir(spark: SparkSession) -> str:
    """The run's folder in the one that driver and executors share (spark.checkpoint.dir).

    Where that is unset, a local session (tests, bench) gets a new folder of the machine; on a cluster it is an error,
    as each executor would write to its own disk. All that a run writes lies under one folder named by the
    application's id, which its owner may remove when the application has ended.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/panelloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the worker gives its free memory back: it is used again by tasks of other stages."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_anew(aggregated: DataFrame, *keys: str) -> DataFrame:
    """``aggregated`` with long ``keys`` that the planner takes for new ones.

    An aggregate that is joined back on its grouping key is joined where it lies, above its own shuffle, and adaptive
    execution can't split the other side's hot partitions then: it would have to read the aggregate's twice. With
    keys of its own the (much smaller) aggregate is shuffled once more, and the join is one that can be split.
    """
    return aggregated.withColumns({k: F.bitwise_not(F.bitwise_not(F.col(k))) for k in keys})


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression named inside a lambda is evaluated again for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, op) -> Column:
    """Of an array, what ``op`` (associative) makes of ``zero`` and all elements before each: one element more than ``values``.

    Done in strides, since an array that grows by an element is copied: time is near n x stride, not n x n.
    """

    def within(part: Column, start: Column) -> Column:
        """All running values of a short array, ``start`` first."""
        grow = lambda acc, x: let(op(F.element_at(acc, -1), x), lambda v: F.concat(acc, F.array(v)))
        return F.aggregate(part, F.array(start), grow)

    def of(all_: Column) -> Column:
        n = F.size(all_)
        strides = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / F.lit(_STRIDE)).cast("int") - 1, F.lit(0))), lambda i: F.slice(all_, i * _STRIDE + 1, _STRIDE))

        def joined(parts: Column) -> Column:
            starts = within(F.transform(parts, lambda p: F.aggregate(p, zero, op)), zero)
            # Each stride's last running value is the next one's first.
            rows = lambda s: F.zip_with(parts, F.slice(s, 1, F.size(parts)), lambda p, a: F.slice(within(p, a), 1, F.size(p)))
            return let(starts, lambda s: F.concat(F.flatten(rows(s)), F.array(F.element_at(s, -1))))

        return F.when(n == 0, F.array(zero)).otherwise(let(strides, joined))

    return let(values, of)


def pieces_of(text: Column) -> Column:
    """A text as an array of pieces of a fixed number of code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start..end (exclusive, from 0) of the text whose ``pieces_of`` are given: costs what it takes out."""
    first = F.floor(start / F.lit(_PIECE)).cast("int")
    last = F.floor((end - 1) / F.lit(_PIECE)).cast("int")

    def part(p: Column, i: Column) -> Column:
        at = (first + i) * _PIECE
        low, high = F.greatest(start - at, F.lit(0)), F.least(end - at, F.lit(_PIECE))
        return F.when((low == 0) & (high == _PIECE), p).otherwise(F.substring(p, low + 1, high - low))

    return F.when(end > start, F.array_join(F.transform(F.slice(pieces, first + 1, last - first + 1), part), "")).otherwise(F.lit(""))


def words(text: Column) -> Column:
    """Words of the whole text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def sample_ids(ids: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of ``ids`` (distinct ``key``): those with the least hashes of it.

    A first cut by the hash's range leaves about 1.5 n rows, whatever the table's size, so that the ordering
    which fixes the sample is small. The same rows come out on any cluster.
    """
    total = ids.count()
    if total > 2 * n:
        space = 1 << 40
        ids = ids.where(F.pmod(F.xxhash64(key), F.lit(space)) < F.lit(space * 3 * n // (2 * total)))
    return ids.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 40)), key).limit(n)
