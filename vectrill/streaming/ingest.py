"""Structured Streaming ingest: every micro-batch is one upsert, committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..collection import Collection


def stream_upsert(stream: DataFrame, collection: Collection, checkpoint: str, order: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream (id, vector, and if there document, metadata) into a collection.

    A batch that is run again after a failure replaces the rows that it wrote, so the collection ends up the same. Of
    an id that occurs twice in a batch the last in ``order`` counts.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        collection.upsert_frame(batch, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
