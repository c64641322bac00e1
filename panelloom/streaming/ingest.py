"""Ingestion that can stop anywhere and go on: a stream of observations into the point-in-time store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelloom.operators.pit import PointInTimeStore


def ingest_available(stream: DataFrame, store: PointInTimeStore, checkpoint: str) -> None:
    """Takes in all that ``stream`` has now and ends. A later call with the same ``checkpoint`` goes on behind it.

    A batch that was cut off is done again as a whole; as ingesting rows twice changes nothing, the store is the same as after one run.
    """

    def sink(batch: DataFrame, _: int) -> None:
        PointInTimeStore(batch.sparkSession, store.root).ingest(batch)

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
