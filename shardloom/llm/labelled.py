"""Labelled samples of bounded size, and scoring of whole tables in one pass over the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.llm.batches import map_batches, without
from shardloom.session import materialize

# Labelled texts that a classifier is fitted on, at most; taken in the order of a hash of doc_id and text.
SAMPLE_ROWS = 24_000


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text divisible by 5; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(h, text, y) of at most ``limit`` labelled texts that may be learned from.

    Labels meet the ids and text prints of ``docs`` first, so only texts that are there count towards the limit; each text of
    an id counts once, however often its row occurs. The chosen rows are bounded, so they are sent to the scan of the texts.
    Labels that are null, or that contradict each other for one id, are left out.
    """
    marked = (
        labels.where(~held_out(key) & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("_most"))
        .where("y = _most").select(F.col(key).alias("_id"), F.col("y").cast("int").alias("y"), F.xxhash64(key).alias("h"))
    )
    text_print = [F.xxhash64(F.col(f"`{text}`")).alias("_x"), F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(-1)).alias("_c")]
    own = docs.where(~held_out(key)).select(F.col(f"`{key}`").alias("_id"), *text_print)
    chosen = materialize(
        own.join(marked, "_id").groupBy("_id", "_x", "_c").agg(F.min("y").alias("y"), F.min("h").alias("h"))
        .orderBy(F.xxhash64("_id", "_x", "_c"), "_id", "_x", "_c").limit(limit), "chosen")
    rows = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("text"), *text_print)
    return (
        rows.join(F.broadcast(chosen), ["_id", "_x", "_c"]).groupBy("_id", "_x", "_c")
        .agg(F.first("h").alias("h"), F.first("text").alias("text"), F.first("y").alias("y")).select("h", "text", "y")
    )


def collect_features(sample: DataFrame, features: Sequence[Callable[[list[bytes]], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and hashes of a bounded sample, in an order of their own; row ``h`` uses ``features[h mod their number]``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [raw or b"" for raw in batch.column("text").cast(pa.binary()).to_pylist()]
            made = [features[h % len(features)]([t])[0] for h, t in zip(batch.column("h").to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("y"), pa.array(made, pa.list_(pa.float64()))], ["h", "y", "x"])

    rows = map_batches(sample, step, "h bigint, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["h"], r["x"]))
    width = features[0]([]).shape[1]
    return (np.array([r["x"] for r in rows], float).reshape(-1, width), np.array([r["y"] for r in rows], float), np.array([r["h"] for r in rows], np.int64))


def score_texts(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score for each text; null counts as empty. Row-local; a column of that name is replaced."""
    docs = without(docs, [name])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields] + [T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(score)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = sent.value([raw or b"" for raw in batch.column(text).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], [*batch.schema.names, name])

    return map_batches(docs, step, schema)
