"""Streams into a store: each micro-batch is one commit, and a batch that comes again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from halyard.sources.store import VectorStore


def ingest(stream: DataFrame, store: VectorStore, checkpoint: str, *, mode: str = "add_once", name: str = "ingest", tidy: int | None = None, **trigger: object) -> StreamingQuery:
    """Write a stream (key, vec [, seq]) by `add`, `add_once` or `upsert`; `trigger` goes to writeStream.trigger.

    `tidy` merges small folders by that ratio after each micro-batch, so that a long stream keeps few of them.
    """
    if mode not in ("add", "add_once", "upsert"):
        raise ValueError("mode must be add, add_once or upsert")
    write = getattr(store, mode)

    def put(df: DataFrame, i: int) -> None:
        write(df, commit=f"{name}-{i}")
        if tidy is not None:
            store.tidy(tidy)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
