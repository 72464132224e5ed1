"""Backup lines and the manifest beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.text import is_blank
from shardloom.sources import files
from shardloom.sources.csv import row_ordinal

# The backup line and manifest formats.
LINE_SCHEMA = "id string, payload variant, vector variant, shard_key string"
MANIFEST_SCHEMA = (
    "version int, collection string, vector_size int, uses_custom_sharding boolean, tenant_payload_field string, "
    "shard_keys_exported array<string>, points_total bigint, points_per_shard map<string,bigint>"
)
BACKUP_VERSION = 1
DEFAULT_LABEL = "__default__"


def manifest_path(path: str) -> str:
    """``points.jsonl`` or the folder ``points`` has its manifest in ``points.meta.json``."""
    folder, _, name = path.rstrip("/").rpartition("/")
    stem = name.rpartition(".")[0] or name
    return f"{folder}/{stem}.meta.json"


def scan_backup(spark: SparkSession, path: str, line_numbers: bool = False) -> DataFrame:
    """Backup lines as ``(id, payload, vector, named_vectors, shard_key, parsed)``; blank lines are skipped.

    ``line_numbers`` adds ``line_no`` (from 1, blank lines counted). It costs one more pass over the
    file, so it is left for the report about a backup that was found to be wrong.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    if line_numbers:
        lines = row_ordinal(lines, "line_no").withColumn("line_no", F.col("line_no") + 1)
    else:
        lines = lines.select(
            "value",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("start"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("line_order"),
        )
    row = F.from_json("value", LINE_SCHEMA)
    keep = [c for c in lines.columns if c != "value"]
    return (
        lines.where(~is_blank(F.col("value")))
        .withColumn("row", row)
        .select(
            *keep,
            F.col("row.id").alias("id"),
            F.col("row.payload").alias("payload"),
            F.try_variant_get("row.vector", "$", "array<double>").alias("vector"),
            F.try_variant_get("row.vector", "$", "map<string,array<double>>").alias("named_vectors"),
            F.col("row.shard_key").alias("shard_key"),
            F.col("row.id").isNotNull().alias("parsed"),
        )
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The one-row manifest of a backup, or None where the backup has none."""
    location = manifest_path(path)
    if not files.exists(spark, location):
        return None
    return (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("multiLine", True)
        .json(location)
        .withColumn("shard_keys_exported", F.coalesce("shard_keys_exported", F.array().cast("array<string>")))
        .withColumn("points_per_shard", F.coalesce("points_per_shard", F.create_map().cast("map<string,bigint>")))
    )
