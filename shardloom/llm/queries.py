"""One query for each operator over the given tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import (
    byte_bpe, conversation_repair, feistel_shards, html_layout, multi_index, order_minhash, periodic_runs, quality, token_blocks,
    toxicity, trie_counts, warc_zip, wu_manber,
)
from shardloom.llm.batches import table
from shardloom.llm.labelled import held_out

SHARDS = 40
NEIGHBOURS = 10


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_blocks.encode_corpus(table(spark, sf_dir, "documents"))
    return token_blocks.read_token_files(spark, folder, manifest, with_ids=False)


def _scored(docs: DataFrame, threshold: float) -> DataFrame:
    return docs.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.score(docs, model), quality.THRESHOLD)


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract_text(table(spark, sf_dir, "pages")).select("page_id", "text")


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 16).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = feistel_shards.shard_rows(docs, SHARDS, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, NEIGHBOURS)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs, model), toxicity.THRESHOLD)


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wu_manber.report(wu_manber.find_items(docs, table(spark, sf_dir, "benchmark")))


def op9_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "n_pretokens")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op11_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc_zip.archive_pages(table(spark, sf_dir, "pages"))
    records = warc_zip.read_packages(packages, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damage_rows(conversation_repair.read_rows(table(spark, sf_dir, "conversations")))
    return conversation_repair.repair_digests(rows).withColumnRenamed("conv", "conv_id").drop("rows")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents"), damage=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    run.__name__: run
    for run in (
        op1_token_blocks, op2_quality, op3_html_layout, op4_feistel_shards, op5_multi_index, op6_byte_bpe, op7_toxicity,
        op8_wu_manber, op9_trie_counts, op10_order_minhash, op11_warc_zip, op12_conversation_repair, op13_periodic_runs,
    )
}

_BYTES = "encode(coalesce(text, ''))"

# CRC-32 is a fold over the bytes with a table of 256 entries; the shuffle is the Feistel rounds in recursive form.
_OP4 = f"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT range::UINTEGER, range::UINTEGER, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
sums AS (
  SELECT doc_id, (octet_length({_BYTES}) + 16)::BIGINT AS size,
    list_reduce(
      list_transform(range(1, 2 * octet_length({_BYTES}) + 1, 2), lambda i: ('0x' || substr(hex({_BYTES}), i, 2))::UINTEGER),
      lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::UINTEGER)::UINTEGER AS folded
  FROM documents, crc
), sized AS (
  SELECT doc_id, size, CASE WHEN size = 16 THEN 0 ELSE xor(folded, 4294967295::UINTEGER)::BIGINT END AS text_crc32 FROM sums
), n AS (SELECT count(*) AS rows, (floor(sqrt(count(*) - 1)) + 1)::BIGINT AS a FROM sized),
grid AS (SELECT rows, a, (rows + a - 1) // a AS b FROM n),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x FROM sized
), walk(num, l, r, i, done) AS (
  SELECT x, x // b, x % b, 0, false FROM numbered, grid
  UNION ALL
  SELECT num,
    CASE WHEN i < {feistel_shards.ROUNDS} THEN r ELSE (l * b + r) // b END,
    CASE WHEN i < {feistel_shards.ROUNDS} THEN (l + ('0x' || substr(md5('7:' || i || ':' || r), 1, 12))::BIGINT
      % (CASE WHEN i % 2 = 0 THEN a ELSE b END)) % (CASE WHEN i % 2 = 0 THEN a ELSE b END) ELSE (l * b + r) % b END,
    CASE WHEN i < {feistel_shards.ROUNDS} THEN i + 1 ELSE 0 END,
    i + 1 = {feistel_shards.ROUNDS} AND r * b + (l + ('0x' || substr(md5('7:' || i || ':' || r), 1, 12))::BIGINT
      % (CASE WHEN i % 2 = 0 THEN a ELSE b END)) % (CASE WHEN i % 2 = 0 THEN a ELSE b END) < rows
  FROM walk, grid WHERE NOT done
)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((l * b + r) % {SHARDS})::INTEGER AS shard,
  ((l * b + r) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM walk JOIN numbered ON num = x, grid WHERE done
"""

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP8 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), item AS (
  SELECT item_id::VARCHAR AS item, coalesce({_WORDS}, []) AS w FROM benchmark
), pattern AS (
  SELECT DISTINCT item, len(p) AS size, p FROM (
    SELECT item, unnest(list_transform(range(1, greatest(2, len(w) - {wu_manber.WINDOW} + 2)),
      lambda i: w[i : i + {wu_manber.WINDOW} - 1])) AS p FROM item WHERE len(w) > 0)
), spot AS (
  SELECT n, size, i, w[i : i + size - 1] AS p
  FROM doc, (SELECT DISTINCT size FROM pattern), unnest(range(1, len(w) - size + 2)) AS u(i)
), found AS (
  SELECT n, i, size, item FROM spot JOIN pattern USING (size, p)
), hit AS (
  SELECT n, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + size)) AS u(j) GROUP BY n
), held AS (
  SELECT n, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY n
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (n) LEFT JOIN held USING (n)
"""

_OP11 = f"""
WITH page AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, '')))::BIGINT AS n,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS nth,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS head
  FROM pages
)
SELECT page_id, n AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN n >= {warc_zip.REVISIT_BYTES} AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {warc_zip.REVISIT_BYTES} AND nth > 1 THEN head END AS refers_to
FROM page
"""

ORACLE: dict[str, str] = {"op4_feistel_shards": _OP4, "op8_wu_manber": _OP8, "op11_warc_zip": _OP11}
