"""Streaming upsert and streaming chunk-and-embed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shardloom.plans.collections import CollectionStore


def stream_upsert(arrivals: DataFrame, store: CollectionStore, collection: str, stream: str, checkpoint: str,
                  prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Upsert arriving points in micro-batches until the available input is used up.

    A stored point with a greater ``seq`` stays, so files may arrive in any order, and a batch that is
    replayed after a failure is skipped.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        points = prepare(batch) if prepare else batch
        store.upsert(collection, points, order=["seq"], newer_only=True, stream=(stream, batch_id))

    return (
        arrivals.writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_embed(arrivals: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str,
                 checkpoint: str) -> StreamingQuery:
    """Run a row-local prepare step (chunk, embed) on arriving rows and append the result as Parquet."""
    return (
        transform(arrivals)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
