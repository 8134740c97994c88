"""Batches from a stream: an extension that picks up after a stop where it left off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.sinks import BatchWriter


def commit_stream(stream: DataFrame, writer: BatchWriter, schema: T.StructType, checkpoint: str, transform=None) -> None:
    """Each micro-batch is one committed batch. A batch that a stopped run had committed is not written again."""

    def each(df: DataFrame, batch: int) -> None:
        writer.commit(batch, transform(df) if transform else df, schema)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
