"""Writers: backups, embedded CSV, nested results and the registry."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.operators.prepare import sanitize_numbers
from shardloom.operators.reports import points_per_tenant, tenants_by_collection
from shardloom.sources import files
from shardloom.sources.backup import BACKUP_VERSION, DEFAULT_LABEL, manifest_path


def backup_lines(points: DataFrame, with_tenants: bool = True) -> DataFrame:
    """Points as ``(tenant, value)`` where ``value`` is one backup line; numeric ids stay JSON numbers."""
    numeric = F.col("point_id").rlike("^[0-9]+$")
    fields = [
        F.when(numeric, F.try_parse_json("point_id")).otherwise(F.col("point_id").cast("variant")).alias("id"),
        F.coalesce("payload", F.to_variant_object(F.create_map().cast("map<string,string>"))).alias("payload"),
        F.col("vector").cast("array<double>").alias("vector"),
    ]
    if with_tenants:
        fields.append(F.col("tenant").alias("shard_key"))
    return points.select("tenant", F.to_json(F.struct(*fields)).alias("value"))


def export_points(points: DataFrame, path: str, collection: str, vector_size: int, with_tenants: bool = True,
                  tenant_field: str = "tenant_name") -> dict:
    """Write backup lines, one folder for each tenant, and the manifest beside them."""
    backup_lines(points, with_tenants).write.partitionBy("tenant").text(path)
    counts = {row["label"]: row["points"] for row in points_per_tenant(points).collect()}
    total = counts.pop(None, 0)
    manifest = {
        "version": BACKUP_VERSION,
        "collection": collection,
        "vector_size": vector_size,
        "uses_custom_sharding": with_tenants,
        "tenant_payload_field": tenant_field,
        "shard_keys_exported": sorted(counts) if with_tenants else [],
        "points_total": total,
        "points_per_shard": counts if with_tenants else {DEFAULT_LABEL: total},
    }
    files.write_text(points.sparkSession, manifest_path(path), json.dumps(manifest, indent=2), overwrite=True)
    return manifest


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that :func:`shardloom.sources.csv.scan_csv` reads back as it was, white space included."""
    (
        df.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_embedded_csv(df: DataFrame, path: str, vector: str = "embedding") -> None:
    """CSV with the vector as JSON text. Text vectors, as on untouched rows, are written as they are."""
    if df.schema[vector].dataType.typeName() == "array":
        df = df.withColumn(vector, F.to_json(vector))
    write_csv(df, path)


def nest_results(hits: DataFrame, *columns: str) -> DataFrame:
    """One row per query: ``points`` holds its hits in rank order (at most k of them)."""
    keys = ["query_index", "query_text"] if "query_text" in hits.columns else ["query_index"]
    hit = F.struct("rank", F.col("point_id").alias("id"), "score", *columns)
    return sanitize_numbers(hits).groupBy(*keys).agg(
        F.array_sort(F.collect_list(hit), lambda a, b: a["rank"] - b["rank"]).alias("points"))


def result_json(nested: DataFrame) -> DataFrame:
    """Nested results as JSON text, one block per query."""
    return nested.select("query_index", F.to_json(F.struct(*nested.columns)).alias("value"))


def write_results(nested: DataFrame, path: str) -> None:
    """Nested results as JSON lines in query order."""
    ordered = nested.orderBy("query_index")
    result_json(ordered).select("value").write.text(path)


def registry_json(pairs: DataFrame) -> DataFrame:
    """The registry as one JSON object with sorted keys. It has one entry for each registered tenant."""
    entries: Column = F.array_sort(F.collect_list(F.struct("collection", "tenants")))
    return tenants_by_collection(pairs).agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def save_registry(pairs: DataFrame, path: str) -> None:
    registry_json(pairs).write.mode("overwrite").text(path)
