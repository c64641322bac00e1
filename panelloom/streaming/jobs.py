"""Structured Streaming forms: weekly tone as a windowed aggregate, a keyed Kalman filter as custom state, and a table of what a stream has put out."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelloom.functions.kernels import ScalarFilters


def weekly_tone(events: DataFrame, key: str = "event_type", time: str = "ts", value: str = "value", late: str = "8 days") -> DataFrame:
    """(key, week_start, n, total) in weeks from Monday, rows up to ``late`` behind the newest counted.

    The epoch was a Thursday, so windows of seven days start four days on.
    """
    w = F.window(F.col(time), "7 days", startTime="4 days")
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").cast("date").alias("week_start"), "n", "total")


_OUT = "actor long, step int, value double, predicted double"
_STATE = "actor array<long>, step array<int>, a array<double>, p array<double>, q array<double>"


#: The state store that state by value needs, closed after each batch: an open store of a few rows takes 4 MB of disk a partition, and those of a stream that has ended stay open.
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}


@contextmanager
def state_by_value(spark: SparkSession) -> Iterator[None]:
    """Streams with online_filter start, and end, in here; the session's own state store is set again after."""
    before = {key: spark.conf.get(key) for key in _STORE}
    try:
        for key, value in _STORE.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class _Filters(StatefulProcessor):
    """The filters of one block of actors, side by side; their state is one value, four numbers an actor."""

    def __init__(self, f: float, r: float, q: float, adapt: float):
        self.parameters = f, r, q, adapt

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filters", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([x[["actor", "period", "value"]] for x in rows]).sort_values(["actor", "period"], kind="stable")
        before = self.state.get() if self.state.exists() else ([], [], [], [], [])
        known = np.array(before[0], dtype="int64")
        actors = np.union1d(known, new["actor"].to_numpy())
        filters = ScalarFilters(len(actors), *self.parameters)
        steps, at = np.zeros(len(actors), dtype="int64"), np.searchsorted(actors, known)
        steps[at], filters.a[at], filters.p[at], filters.q[at] = before[1:]
        # Each actor's first new value, then each one's second, and so on.
        new["place"], new["turn"] = np.searchsorted(actors, new["actor"].to_numpy()), new.groupby("actor").cumcount()
        new = new.sort_values("turn", kind="stable")
        place, y, turn = new["place"].to_numpy(), new["value"].to_numpy(dtype="float64"), new["turn"].to_numpy()
        predicted = np.empty(len(y))
        cuts = np.flatnonzero(np.diff(turn, prepend=-1, append=-1))
        for i, j in zip(cuts[:-1], cuts[1:]):
            predicted[i:j] = filters.step(place[i:j], y[i:j])
        out = pd.DataFrame({"actor": actors[place], "step": steps[place] + turn + 1, "value": y, "predicted": predicted})
        steps += np.bincount(place, minlength=len(actors))
        self.state.update(tuple(x.tolist() for x in (actors, steps, filters.a, filters.p, filters.q)))
        yield out

    def close(self) -> None:
        pass


def online_filter(rows: DataFrame, f: float = 0.9, r: float = 0.1, q: float = 0.5, adapt: float = 0.3, blocks: int = 1024) -> DataFrame:
    """One-factor Kalman filter of each actor's values as they arrive: (actor, step, value, predicted).

    Rows (actor, period, value) of one batch are taken in order of ``period``, null last; an order across batches is the source's. Rows
    without an actor belong to no filter. Actors are dealt into ``blocks`` by hash, as a call of the state function costs far more than
    a filter's step; a stream keeps the number that it first started with. It runs within state_by_value.
    """
    dealt = rows.where("actor is not null").withColumn("block", F.pmod(F.xxhash64("actor"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").transformWithStateInPandas(_Filters(f, r, q, adapt), outputStructType=_OUT, outputMode="Append", timeMode="None")


def put_available(out: DataFrame, root: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all there is now and ends; what it puts out lies in ``root``, a folder a batch.

    A batch that was cut off is written again in the same place, so nothing is there twice. A later call with the same ``checkpoint`` goes on, state included.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    out.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(put: DataFrame, keys: list[str]) -> DataFrame:
    """Of what a stream in update mode has put out (with its ``batch``), each key's last row."""
    rest = [c for c in put.columns if c not in (*keys, "batch")]
    return put.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row__")).select(*keys, "row__.*")
