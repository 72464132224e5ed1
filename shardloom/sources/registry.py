"""The tenant registry: a JSON object from collection to its tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(collection, tenants)`` of a registry file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("collection", "tenants"))
