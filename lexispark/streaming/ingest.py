"""Structured Streaming into an index: one generation a micro-batch, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from lexispark.sources.store import Store
from lexispark.sources.writer import IndexWriter


def batch_sink(path: str, stream: str, **options) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch. The manifest that makes a batch visible also records its number, so a batch that is replayed is passed over."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if Store(path).create().current().batches.get(stream, -1) >= batch_id:
            return
        with IndexWriter(batch.sparkSession, path, **options) as writer:
            writer.add_documents(batch)
            writer.batches[stream] = batch_id
            writer.commit()

    return write


def ingest(documents: DataFrame, path: str, checkpoint: str, stream: str = "default", **options) -> DataStreamWriter:
    """A writer, to be started, for a stream of documents (a column `fields`, or `json`)."""
    return documents.writeStream.foreachBatch(batch_sink(path, stream, **options)).option("checkpointLocation", checkpoint)
