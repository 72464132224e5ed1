"""Tables of points, records and registries that Spark derives from the given tables."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.plans.collections import CollectionStore
from shardloom.session import scratch_path, spread_if_narrow

HASH_DIM = 32

# Bytes of text in one file of a written table, about: more text makes more files, not larger ones.
FILE_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_doubles(vector: Column, scale: Column | int = 1) -> Column:
    return F.transform(vector, lambda x: x.cast("double") * scale)


def weighted_sum(vector: Column) -> Column:
    """One number that changes with any element or position of a vector; 0 without a vector, as in SQL."""
    return F.coalesce(F.round(
        F.aggregate(F.transform(vector, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 5
    ), F.lit(0.0))


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a point of the tenant of its label, scaled so that lengths differ."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("T"), "label").alias("tenant"),
        F.col("vec_id").cast("string").alias("point_id"),
        as_doubles(F.col("embedding"), F.col("label") + 1).alias("vector"),
    )


def attributed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the attributes of the document of the same number as payload."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("point_id"), "lang", "source", "n_chars"
    )
    payload = F.to_variant_object(F.struct("lang", F.col("source").alias("filename"), "n_chars"))
    return (
        vector_points(spark, sf_dir).join(docs, "point_id", "left")
        .select("tenant", "point_id", "vector", payload.alias("payload"))
    )


def _mean(vector: str) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(vector)))


def _with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", as_doubles(F.col("embedding")).alias("v"))
    return vectors.join(docs, "vec_id").withColumn("source_no", F.substring("source", 4, 10).cast("int"))


def source_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for each document source: the mean of its vectors."""
    return (
        _with_source(spark, sf_dir).groupBy("source_no", "source").agg(_mean("v").alias("qvec"))
        .select(F.col("source_no").alias("query_index"), F.col("source").alias("query_text"), "qvec")
    )


def tenant_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for each source and tenant: the mean of the vectors they share."""
    return (
        _with_source(spark, sf_dir).groupBy("source_no", "label").agg(_mean("v").alias("qvec"))
        .select(
            (F.col("source_no") * 10 + F.col("label")).cast("int").alias("query_index"),
            F.concat(F.lit("T"), "label").alias("tenant"),
            "qvec",
        )
    )


def label_centroids(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    """One centroid for each label, in label order (the labels are the digits 0 to 9)."""
    means = (
        table(spark, sf_dir, "embeddings").select("label", as_doubles(F.col("embedding")).alias("v"))
        .groupBy("label").agg(_mean("v").alias("c")).orderBy("label").collect()
    )
    return [row["c"] for row in means]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text records of the tenant of their source."""
    return spread_if_narrow(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("uid"), F.col("source").alias("org_id"), "lang", "text", "doc_id"
    )


def text_files(records: DataFrame, least: int = 4) -> int:
    """Number of files for these records, by the bytes of their texts."""
    total = records.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, math.ceil(total / FILE_BYTES))


def in_files(records: DataFrame) -> DataFrame:
    """Records as files of bounded size whose name order is the order of the document numbers."""
    return records.repartitionByRange(text_files(records), "doc_id").sortWithinPartitions("doc_id")


def marked_up(text: Column) -> Column:
    """The test documents hold no markdown: make each line a heading and put images around the text."""
    return F.concat(
        F.lit("![a figure](data:image/png;base64,AAAA) "),
        F.replace(text, F.lit("\n"), F.lit("\n## ")),
        F.lit(' ![b](http://x/y.png)<img src="z">  '),
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of points: the key is event type and user, the sequence is the event number."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tenant"),
        F.col("user_id").cast("string").alias("point_id"),
        F.array("value").alias("vector"),
        F.try_parse_json("props").alias("payload"),
        F.col("event_id").alias("seq"),
        "ts",
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections are languages, their tenants the sources that occur in them."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), F.col("source").alias("tenant"))


def labelled_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the registry that has labelled toxic documents."""
    toxic = table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    return (
        table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi")
        .select(F.col("lang").alias("collection"), F.col("source").alias("tenant"))
    )


def tenant_names(df: DataFrame) -> list[str]:
    """Distinct tenants to register; a registry is metadata, not row data."""
    return [row["tenant"] for row in df.select("tenant").distinct().collect()]


def new_store(spark: SparkSession, name: str) -> CollectionStore:
    return CollectionStore(spark, scratch_path(spark, name))


def vector_store(spark: SparkSession, sf_dir: str, name: str) -> CollectionStore:
    """A store whose collection ``points`` holds every attributed point."""
    store = new_store(spark, name)
    points = attributed_points(spark, sf_dir).withColumn("seq", F.col("point_id").cast("bigint"))
    store.ensure("points", tenant_names(table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("T"), "label").alias("tenant"))), vector_size=64, buckets=4, promoted=["filename"])
    store.upsert("points", points)
    return store
