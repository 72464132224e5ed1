"""A training-data pipeline over ``documents`` from the operators of ``shardloom.llm``.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept. All but the last return the
columns of ``docs``. The classifiers learn from labelled documents among those that reach their stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import byte_bpe, order_minhash, quality, toxicity, wu_manber
from shardloom.llm.batches import table
from shardloom.session import materialize, ship_package


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    ship_package(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not call toxic."""
    ship_package(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest doc_id."""
    ship_package(spark)
    return order_minhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    ship_package(spark)
    return wu_manber.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checksums of ids and decoded bytes of the texts that are left."""
    ship_package(spark)
    return byte_bpe.round_trip(docs)


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_clean),
    ("near_dedup", keep_first),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

# Models, alignments and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
