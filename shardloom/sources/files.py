"""Small metadata files on whatever file system the cluster uses. Row data never passes here."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

# Files whose first bytes are read at a time.
HEADS_AT_ONCE = 16


def _locate(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    fs, location = _locate(spark, path)
    return bool(fs.exists(location))


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, location = _locate(spark, path)
    if not fs.exists(location):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(location))


def delete_tree(spark: SparkSession, path: str) -> bool:
    fs, location = _locate(spark, path)
    return bool(fs.delete(location, True))


def total_bytes(spark: SparkSession, path: str) -> int:
    fs, location = _locate(spark, path)
    return int(fs.getContentSummary(location).getLength())


def write_bytes(spark: SparkSession, path: str, content: bytes, overwrite: bool = False) -> None:
    """Create the file in one step; without ``overwrite`` an existing file is an error."""
    fs, location = _locate(spark, path)
    stream = fs.create(location, overwrite)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    write_bytes(spark, path, text.encode(), overwrite)


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside ``path`` under a hidden name, then rename: readers see the whole file or none.

    A file of that name that is already there stays, and this is an error.
    """
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    write_text(spark, draft, text)
    fs, location = _locate(spark, path)
    if fs.exists(location) or not fs.rename(_locate(spark, draft)[1], location):
        delete_tree(spark, draft)
        raise FileExistsError(f"{path} was written by another commit.")


def read_text(spark: SparkSession, path: str) -> str:
    fs, location = _locate(spark, path)
    stream = fs.open(location)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def listed(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files that Spark reads under ``path``, by name; the listing is the one that planning a scan holds as well."""
    return sorted(spark.read.text(path).inputFiles())


def scan_paths(spark: SparkSession, uris: Sequence[str]) -> list[str]:
    """Names of :func:`listed` as a reader takes them, characters of patterns escaped."""
    jvm = spark.sparkContext._jvm
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString()) for uri in uris]


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, location = _locate(spark, path)
    return bool(fs.exists(location) and fs.getFileStatus(location).isDirectory())


def heads(spark: SparkSession, uris: Sequence[str], size: int) -> list[bytes]:
    """The first ``size`` bytes of each file, unpacked as Spark unpacks them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(uri: str) -> bytes:
        location = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        stream = location.getFileSystem(conf).open(location)
        try:
            codec = codecs.getCodec(location)
            return bytes((codec.createInputStream(stream) if codec else stream).readNBytes(size))
        finally:
            stream.close()

    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        return list(pool.map(first, uris))
