"""Query-vector files: JSON documents and JSON lines."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.json import strict_json
from shardloom.functions.text import is_blank
from shardloom.session import local_table
from shardloom.sources import files
from shardloom.sources.csv import HEAD_BYTES, number_places, place_rows


def _as_vector(element: Column) -> Column:
    """An array of numbers, or the array under ``vector``; null when it is neither."""
    return F.coalesce(
        F.try_variant_get(element, "$.vector", "array<double>"), F.try_variant_get(element, "$", "array<double>")
    )


def _has_lines(head: bytes) -> bool:
    """Whether a file that begins with ``head`` holds one vector on each line, not one document with all of them."""
    text = head.decode("utf-8", "ignore").removeprefix("\ufeff").lstrip()
    first, *more = re.split(r"[\r\n]", text, maxsplit=1)
    try:
        value = json.loads(first)
    except ValueError:
        # A line longer than what was read of it; a document over several lines ends its first line early.
        return not more and (re.match(r"\[\s*[-\d]", first) is not None or re.match(r'\{\s*"vector"\s*:', first) is not None)
    if isinstance(value, list):
        return bool(value) and isinstance(value[0], (int, float))
    return isinstance(value, dict) and "vectors" not in value


def _line_vectors(lines: DataFrame) -> DataFrame:
    return place_rows(lines.where(~is_blank(F.col("value")))).withColumn("qvec", _as_vector(strict_json(F.col("value")))).drop("value")


def _document_vectors(documents: DataFrame) -> DataFrame:
    whole = strict_json(F.col("value"))
    held = F.coalesce(
        F.try_variant_get(whole, "$.vectors", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>")
    )
    by_line = F.transform(
        F.filter(F.split("value", r"\r\n|\r|\n"), lambda line: ~is_blank(line)), lambda line: strict_json(line)
    )
    elements = F.when(whole.isNull(), by_line).when(held.isNotNull(), held).otherwise(F.raise_error(
        F.lit("A query file must hold a list of vectors, an object with 'vectors', or one vector on each line.")))
    return documents.where(~is_blank(F.col("value"))).select(
        F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("bigint").alias("_start"), F.posexplode(elements).alias("_mid", "element")
    ).select("_file", "_start", F.col("_mid").cast("bigint").alias("_mid"), _as_vector(F.col("element")).alias("qvec"))


def scan_query_vectors(spark: SparkSession, path: str | list[str], layout: str = "auto") -> DataFrame:
    """Rows ``(query_index, qvec)`` from ``[[..]]``, ``{"vectors": [..]}``, or one JSON value per line.

    ``ndjson`` reads every file line by line and splits large ones. ``auto`` looks at the first line of each file and does
    the same with those that hold a vector on it; the others are documents, which are read whole. Queries are numbered
    over all files, by name. An element that is no vector has a null ``qvec``.
    """
    if layout not in ("auto", "ndjson"):
        raise ValueError("layout must be 'auto' or 'ndjson'.")
    if layout == "ndjson":
        found = [_line_vectors(spark.read.text(path))]
    else:
        by_line: dict[bool, list[str]] = {True: [], False: []}
        listed = files.listed(spark, path)
        for uri, head in zip(listed, files.heads(spark, listed, HEAD_BYTES)):
            by_line[_has_lines(head)].append(uri)
        found = [
            make(spark.read.text(files.scan_paths(spark, by_line[kind]), wholetext=not kind))
            for kind, make in ((True, _line_vectors), (False, _document_vectors)) if by_line[kind]
        ]
    if not found:
        return local_table(spark, [], "query_index int, qvec array<double>")
    numbered = number_places(reduce(DataFrame.unionByName, found), "query_index")
    return numbered.select(F.col("query_index").cast("int").alias("query_index"), "qvec")
