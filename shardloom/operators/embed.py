"""Batch text embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.rows import only_if
from shardloom.functions.text import embeddable_text, prefix_text
from shardloom.functions.vectors import hash_embed

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]


def embed_text(df: DataFrame, load_model: Callable[[], Embedder], text: str = "text", vector: str = "embedding",
               input_type: str = "passage", batch_size: int = 100, spread: int | None = None, any_text: bool = False) -> DataFrame:
    """Add the vector of each text with any batch model.

    ``load_model`` runs once in each task and returns a function from a list of texts to their vectors, None where a text has none.
    Unusable text gets a null vector; with ``any_text`` only blank text is. ``spread`` repartitions first, so that slow model calls are
    shared evenly after one document became many chunks.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            rows = texts.notna().to_numpy().nonzero()[0]
            for start in range(0, len(rows), batch_size):
                part = rows[start:start + batch_size]
                for row, values in zip(part, model(texts.iloc[part].tolist()), strict=True):
                    out.iat[row] = None if values is None else np.asarray(values, dtype=np.float32)
            yield out

    spread_out = df.repartition(spread) if spread else df
    return spread_out.withColumn(vector, embed(prefix_text(embeddable_text(F.col(text), any_text), input_type)))


def embed_by_hash(df: DataFrame, dim: int, text: str = "text", vector: str = "embedding",
                  input_type: str = "", drop_missing: bool = False, any_text: bool = False) -> DataFrame:
    """Add a deterministic feature-hash vector; it needs no model and stays in the JVM.

    ``drop_missing`` drops the rows whose text has no vector; with ``any_text`` the text ``nan`` has one.
    """
    embedded = hash_embed(prefix_text(embeddable_text(F.col(text), any_text), input_type), dim)
    return df.withColumn(vector, only_if(embedded, lambda v: v.isNotNull()) if drop_missing else embedded)
