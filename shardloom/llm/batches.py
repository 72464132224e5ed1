"""Arrow batches of bounded size between Spark and the operators' Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

# A batch of texts holds at most this many rows and about this many bytes, however long single texts are.
BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(step, schema)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns whose names an operator adds, so that they never occur twice."""
    taken = {name.lower() for name in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path as Spark names it, and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else f"file://{path}")
