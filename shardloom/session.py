"""Session defaults and the shared folder for written intermediate results."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "shardloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's defaults; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python workers can import it wherever they run."""
    from shardloom.sources import files

    context = spark.sparkContext
    if getattr(context, "_shardloom_shipped", False):
        return
    package = Path(__file__).parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    path = f"{scratch_path(spark, 'package')}/shardloom.zip"
    files.write_bytes(spark, path, archive.getvalue())
    context.addPyFile(path)
    context._shardloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` as the cluster set it.

    Only a local master may run without the setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    folder = tempfile.mkdtemp(prefix="shardloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table inside the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# A table of up to this many short rows may live on the driver and be sent to every task.
LOCAL_ROWS = 100_000


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small table inside the plan itself, so that the optimizer knows its size."""
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return spark.createDataFrame(
        pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow), fields
    )


def local_if_small(df: DataFrame, limit: int = LOCAL_ROWS) -> DataFrame:
    """``df`` as a table to broadcast if it has at most ``limit`` rows, else ``df`` itself."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return F.broadcast(local_table(df.sparkSession, rows, schema))


def spread_if_narrow(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has cores.

    For work that is heavy for each row over few input files; a large scan has splits enough and is
    left as it is. ``df`` must be a scan with projections and filters only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
