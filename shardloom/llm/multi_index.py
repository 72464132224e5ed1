"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: vectors are centred, and several rotations are learned on a bounded sample so that signs lose little (alternating
sign assignment and orthogonal fit). The signs of all rotations make a code of ``BITS`` bits, split into substrings of 16
bits, and each substring is an index of its own. A code within Hamming radius R = m * r + a of a query agrees with it to r
bits in one of the first a + 1 substrings or to r - 1 bits in one of the others (pigeonhole), so probing the substring
indexes to these radii finds every code within R. The finds are checked by their whole code and ranked by the exact
Euclidean distance of the original vectors in double precision; ties go to the smaller id.

The radius is learned too: the one that holds ``TARGET`` of the true neighbours of sampled queries. Neighbours in the whole
table are nearer than in a sample, so recall there is higher. A query that finds fewer than k rows is searched again
without a radius.

Every row is indexed. Null vectors, vectors of another length than the commonest, all-zero ones and those with null or
non-finite components take no part, neither as queries nor as candidates. Rows that repeat an id are candidates each; of
query rows that repeat an id the least vector counts. An empty table or query set gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardloom.llm.batches import map_batches
from shardloom.session import materialize

BITS = 256
SUB = 16
# Rows that rotations and radius are learned on, at most, and how many of them serve as queries.
SAMPLE_ROWS = 8192
SAMPLE_QUERIES = 256
TARGET = 0.97
TURNS = 30
# Rows indexed together in a task, and bytes of query vectors sent to the tasks at once.
BLOCK_ROWS = 16_384
SHARE_BYTES = 16 << 20

_POPCOUNT = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


@dataclass
class Rotations:
    """What is learned: centre, one matrix for each group of bits, and the search radius."""

    centre: np.ndarray
    matrices: np.ndarray
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        centred = vectors - self.centre
        signs = np.concatenate([centred @ m for m in self.matrices], axis=1) > 0
        short = -signs.shape[1] % SUB
        packed = np.packbits(np.pad(signs, ((0, 0), (0, short))), axis=1, bitorder="little")
        return packed.view("<u2")


def _rotation(centred: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix under which the signs of ``centred`` are close to its values."""
    dim = centred.shape[1]
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    for _ in range(TURNS):
        left, _, right = np.linalg.svd(centred.T @ np.where(centred @ turn > 0, 1.0, -1.0))
        turn = left @ right
    return turn


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def learn(sample: np.ndarray, k: int, bits: int = BITS, seed: int = 11) -> Rotations:
    dim = sample.shape[1]
    rng = np.random.default_rng(seed)
    centre = sample.mean(axis=0)
    count = -(-bits // dim)
    learned = Rotations(centre, np.stack([_rotation(sample - centre, rng) for _ in range(count)]), count * dim)
    if len(sample) <= k + 1:
        return learned
    codes = learned.codes(sample)
    apart = []
    for q in range(min(SAMPLE_QUERIES, len(sample))):
        away = distances(sample[q], sample)
        away[q] = np.inf
        near = np.argpartition(away, k)[:k]
        apart.append(_POPCOUNT[codes[near] ^ codes[q]].sum(axis=1))
    learned.radius = int(np.quantile(np.concatenate(apart), TARGET, method="higher"))
    return learned


class SubstringIndexes:
    """One index for each substring: its values in order, and the rows that hold each value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for column in codes.T:
            rows = np.argsort(column, kind="stable")
            self.tables.append((*np.unique(column, return_counts=True), rows))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits."""
        parts = len(self.tables)
        each, more = divmod(radius, parts)
        hit = np.zeros(len(self.codes), bool)
        for s, (values, counts, rows) in enumerate(self.tables):
            reach = each if s <= more else each - 1
            if reach < 0:
                continue
            near = _POPCOUNT[values ^ code[s]] <= reach
            hit[rows[np.repeat(near, counts)]] = True
        found = np.flatnonzero(hit)
        return found[_POPCOUNT[self.codes[found] ^ code].sum(axis=1) <= radius]


def usable(vector: str, dim: int) -> Column:
    """The condition for a row to take part."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def index_rows(rows: DataFrame, learned: Rotations, dim: int) -> DataFrame:
    """``rows`` (id, vector) with their codes, written."""
    sent = rows.sparkSession.sparkContext.broadcast(learned)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = sent.value.codes(_matrix(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "vector", "code"])

    return materialize(map_batches(rows, step, "id bigint, vector array<double>, code binary"), "codes")


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK_ROWS:
            yield _block(held, dim)
            held, size = [], 0
    if size:
        yield _block(held, dim)


def _block(held: list[pa.RecordBatch], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.concatenate([np.asarray(b.column("id")) for b in held])
    vectors = np.concatenate([_matrix(b.column("vector"), dim) for b in held])
    raw = b"".join(code for b in held for code in b.column("code").to_pylist())
    return ids, vectors, np.frombuffer(raw, "<u2").reshape(len(ids), -1)


def _scan(index: DataFrame, share: tuple[np.ndarray, np.ndarray], learned: Rotations, radius: int, k: int, dim: int) -> DataFrame:
    """The k best rows of each task for each query of the share."""
    sent = index.sparkSession.sparkContext.broadcast((share, learned))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (query_ids, queries), model = sent.value
        codes = model.codes(queries)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        for ids, vectors, held in _blocks(batches, dim):
            tables = SubstringIndexes(held)
            for q, query in enumerate(queries):
                found = tables.within(codes[q], radius)
                found = found[ids[found] != query_ids[q]]
                away = np.concatenate((best[q][0], distances(query, vectors[found])))
                names = np.concatenate((best[q][1], ids[found]))
                if len(away) > k:
                    near = away <= np.partition(away, k - 1)[k - 1]
                    away, names = away[near], names[near]
                    order = np.lexsort((names, away))[:k]
                    away, names = away[order], names[order]
                best[q] = away, names
        counts = [len(away) for away, _ in best]
        if sum(counts):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(query_ids, counts)), pa.array(np.concatenate([names for _, names in best])),
                pa.array(np.concatenate([away for away, _ in best]))], ["query_id", "vec_id", "score"])

    return map_batches(index, step, "query_id bigint, vec_id bigint, score double")


def _shares(queries: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query set in shares of bounded bytes."""
    rows = max(1, SHARE_BYTES // (8 * dim))
    held: list = []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == rows:
            yield np.array([r[0] for r in held]), np.array([r[1] for r in held])
            held = []
    if held:
        yield np.array([r[0] for r in held]), np.array([r[1] for r in held])


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    table: DataFrame, queries: Column, k: int, key: str = "vec_id", vector: str = "embedding", bits: int = BITS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row of ``table`` where ``queries`` holds.

    A row is no candidate of its own id. The query set is sent in shares; each share is one pass over the index, in which
    a task gives k rows for each query at most.
    """
    spark = table.sparkSession
    rows = table.select(
        F.col(f"`{key}`").cast("bigint").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asked")).where("id IS NOT NULL")
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = sizes["d"]
    rows = rows.where(usable("vector", dim))
    sample = rows.orderBy(F.xxhash64("id"), "vector").limit(SAMPLE_ROWS).select("vector").collect()
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    learned = learn(np.array([r[0] for r in sample]), k, bits)
    index = index_rows(rows.select("id", "vector"), learned, dim)
    asked = materialize(rows.where("asked").groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    parts = [_scan(index, share, learned, learned.radius, k, dim) for share in _shares(asked, dim)]
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    hits = materialize(_ranked(parts, k), "hits")
    # Queries that found fewer rows than they could are searched without a radius.
    full = hits.groupBy("query_id").count().where(F.col("count") >= k)
    short = asked.join(full, asked["id"] == full["query_id"], "left_anti")
    again = [_scan(index, share, learned, learned.matrices.shape[0] * dim, k, dim) for share in _shares(short, dim)]
    if again:
        missed = short.select(F.col("id").alias("query_id"))
        hits = hits.join(missed, "query_id", "left_anti").unionByName(_ranked(again, k))
    return hits.select("query_id", "rank", "vec_id", "score")
