"""Joins against registries, new vectors and snapshots.

No join here is forced to broadcast: Spark measures each side and broadcasts what is small, and
adaptive execution splits the partitions of hot keys where it shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tenant_semi(df: DataFrame, registry: DataFrame, tenant: str = "tenant") -> DataFrame:
    """Rows whose tenant is registered."""
    return df.join(registry.select(tenant), tenant, "left_semi")


def tenant_anti(df: DataFrame, registry: DataFrame, tenant: str = "tenant") -> DataFrame:
    """Rows whose tenant is not registered (or missing)."""
    return df.join(registry.select(tenant), tenant, "left_anti")


def overlay_embeddings(existing: DataFrame, new: DataFrame, uid: str = "uid", vector: str = "embedding",
                       order: str | None = None) -> DataFrame:
    """Put new vectors over old ones by uid.

    A null never overwrites and unknown uids are not added. Several new vectors for one uid are first
    reduced to the last by ``order`` (the largest vector where there is none), so rows never multiply.
    """
    usable = new.where(F.col(vector).isNotNull() & F.col(uid).isNotNull())
    pick = F.max_by(vector, order) if order else F.max(vector)
    latest = usable.groupBy(uid).agg(pick.alias("_new"))
    if vector not in existing.columns:
        existing = existing.withColumn(vector, F.lit(None).cast(new.schema[vector].dataType))
    columns = [F.coalesce("_new", vector).alias(vector) if c == vector else F.col(c) for c in existing.columns]
    return existing.join(latest, uid, "left").select(*columns)


def label_results(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Attach ``query_text`` to hits by ``query_index``; hits without a text keep null."""
    return hits.join(queries.select("query_index", "query_text"), "query_index", "left")


def registry_diff(requested: DataFrame, existing: DataFrame, missing: str = "created",
                  present: str = "skipped") -> DataFrame:
    """Status of each requested ``(collection, tenant)``: ``missing`` or ``present`` in the registry."""
    keys = ["collection", "tenant"]
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    return (
        requested.select(*keys)
        .where(F.col("tenant") != "")
        .distinct()
        .join(known, keys, "left")
        .select(*keys, F.when(F.col("_known"), present).otherwise(missing).alias("status"))
    )


def ensure_report(requested: DataFrame, existing: DataFrame) -> DataFrame:
    return registry_diff(requested, existing, "created", "skipped")


def delete_report(requested: DataFrame, existing: DataFrame) -> DataFrame:
    return registry_diff(requested, existing, "skipped", "deleted")


def tenant_except(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ``(collection, tenant)`` of ``left`` that ``right`` lacks."""
    keys = ["collection", "tenant"]
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def tenant_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    keys = ["collection", "tenant"]
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_semi")


def replace_tenant_slice(table: DataFrame, new_rows: DataFrame, tenant: str, field: str = "org_id") -> DataFrame:
    """All rows of other tenants, untouched, plus the new rows; either side may lack columns."""
    return table.where(~F.col(field).eqNullSafe(tenant)).unionByName(new_rows, allowMissingColumns=True)


def snapshot_restore(snapshot: DataFrame, current: DataFrame, priority: str = "snapshot",
                     keys: tuple[str, ...] = ("tenant", "point_id")) -> DataFrame:
    """Whole rows of both tables by key; ``priority`` says whose row wins where both have one."""
    if priority not in ("snapshot", "replica"):
        raise ValueError("priority must be 'snapshot' or 'replica'.")
    first, second = (snapshot, current) if priority == "snapshot" else (current, snapshot)
    columns = first.columns
    left = first.select(*keys, F.struct(*columns).alias("_first"))
    right = second.select(*keys, F.struct(*columns).alias("_second"))
    return left.join(right, list(keys), "full_outer").select(F.coalesce("_first", "_second").alias("row")).select("row.*")
