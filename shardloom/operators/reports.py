"""Aggregations: manifests, registries, de-duplication and load reports. All combine before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.sources.backup import DEFAULT_LABEL


def points_per_tenant(points: DataFrame) -> DataFrame:
    """Rows ``(label, points)`` for each tenant, and one with a null label for the total."""
    tenant = F.coalesce("tenant", F.lit(DEFAULT_LABEL))
    return (
        points.select(tenant.alias("tenant"))
        .rollup("tenant")
        .agg(F.count("*").alias("points"), F.grouping("tenant").alias("is_total"))
        .select(F.when(F.col("is_total") == 0, F.col("tenant")).alias("label"), "points")
    )


def backup_manifest(points: DataFrame) -> DataFrame:
    """One row ``(points_total, points_per_shard)``; the map has one entry for each tenant."""
    counts = points_per_tenant(points)
    labelled = F.filter(F.collect_list(F.struct("label", "points")), lambda e: e["label"].isNotNull())
    return counts.agg(
        F.coalesce(F.max(F.when(F.col("label").isNull(), F.col("points"))), F.lit(0)).alias("points_total"),
        F.map_from_entries(F.array_sort(labelled)).alias("points_per_shard"),
    )


def tenants_by_collection(pairs: DataFrame) -> DataFrame:
    """Sorted distinct tenants of each collection."""
    return (
        pairs.select("collection", "tenant")
        .distinct()
        .groupBy("collection")
        .agg(F.array_sort(F.collect_list("tenant")).alias("tenants"))
    )


def dedupe_first(df: DataFrame, value: str, position: str) -> DataFrame:
    """First position of each distinct value; null and empty values are dropped."""
    return df.where(F.col(value) != "").groupBy(value).agg(F.min(position).alias(position))


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The whole last row of each key."""
    order_by = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order_by).alias("_row")).select("_row.*")
    )


def load_report(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """One row: rows read, rows kept, and rows dropped for each reason (the first that applies)."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(list(reasons.items())):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    return df.select(reason.alias("reason")).agg(
        F.count("*").alias("rows_read"),
        F.count_if(F.col("reason").isNull()).alias("rows_kept"),
        *[F.count_if(F.col("reason") == name).alias(f"dropped_{name}") for name in reasons],
    )
