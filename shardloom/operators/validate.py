"""Checks that return their violations as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.text import embeddable_text
from shardloom.functions.vectors import all_finite
from shardloom.operators.prepare import import_tenant


def dim_violations(df: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """Rows whose vector is missing, of the wrong size, not finite, or without direction, with the reason."""
    size = F.size(vector)
    reason = (
        F.when(F.col(vector).isNull(), F.lit("missing vector"))
        .when(size != dim, F.concat(F.lit("dimension "), size.cast("string"), F.lit(f" != expected {dim}")))
        .when(~all_finite(F.col(vector)), F.lit("not finite"))
        .when(F.forall(vector, lambda x: x == 0), F.lit("zero vector"))
    )
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def text_violations(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text cannot be embedded."""
    return df.where(embeddable_text(F.col(text)).isNull())


def import_violations(lines: DataFrame, dim: int, registry: DataFrame | None, field: str = "tenant_name") -> DataFrame:
    """Backup lines that must not be imported, with the reason.

    ``registry`` holds the registered tenants in ``tenant``; None means an unpartitioned collection.
    """
    reason = (
        F.when(~F.col("parsed"), F.lit("malformed line"))
        .when(F.col("named_vectors").isNotNull(), F.lit("named vectors"))
        .when(F.col("vector").isNull(), F.lit("missing vector"))
        .when(
            F.size("vector") != dim,
            F.concat(F.lit("dimension "), F.size("vector").cast("string"), F.lit(f" != expected {dim}")),
        )
        .when(~all_finite(F.transform("vector", lambda x: x.cast("float"))), F.lit("not finite"))
    )
    if registry is None:
        checked = lines.withColumn("reason", reason)
    else:
        known = registry.select("tenant").distinct().withColumn("_known", F.lit(True))
        checked = (
            lines.withColumn("tenant", import_tenant(field=field))
            .join(known, "tenant", "left")
            .withColumn(
                "reason",
                F.when(~F.col("parsed"), F.lit("malformed line"))
                .when(F.col("tenant").isNull(), F.lit("shard key missing"))
                .when(F.col("_known").isNull(), F.lit("shard key not registered"))
                .otherwise(reason),
            )
            .drop("_known")
        )
    return checked.where(F.col("reason").isNotNull())
