"""Cosine top-k search.

Two exact plans give the same hits. A query set of bounded size is sent, in shares, to the tasks that
scan the points, and each task keeps a running top-k, so no point is shuffled, also where each query searches a group
of points of its own. For a larger query set the points are dealt once into blocks of bounded size, and the queries pass by
every block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from itertools import chain, pairwise
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.vectors import SCORE_DECIMALS, all_finite, normalize
from shardloom.session import local_if_small, local_table, materialize

# In the order that breaks ties.
ID_COLUMNS = ("point_id", "tenant")
HIT_SCHEMA = "query_index int, point_id string, tenant string, score double"

# Sizes of what one task holds at a time.
QUERY_BROADCAST_BYTES = 64 << 20
QUERY_PASSES = 16
HITS_BROADCAST_ROWS = 1_000_000
BLOCK_BYTES = 64 << 20
# From so many scanning tasks on a first scan of some of them pays.
FLOOR_TASKS = 64
SCORE_CELLS = 4 << 20
# More blocks of points than this share partitions.
MOST_PARTITIONS = 20_000


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column of ``dim`` numbers as a matrix of unit rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return values / norms


class _TopK:
    """Best ``k`` of each query over the blocks seen: score descending, then id ascending."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.queries = queries
        self.k = k
        # Entries are (-score, id), so the natural order is best first.
        self.best: list[list[tuple[float, tuple[str, ...]]]] = [[] for _ in range(len(queries))]
        # What scores less is not among the best ``k``; a floor known before may be above this task's own.
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor.copy()

    def add(self, block: pa.RecordBatch | pa.Table) -> None:
        scores = self.queries @ _matrix(block.column("vector"), self.queries.shape[1]).T
        # Scores are compared rounded, but only the few that come near the current floor are rounded.
        reach = self.floor - 10.0**-SCORE_DECIMALS
        chosen = {int(q): self._candidates(q, scores[q], reach[q]) for q in np.nonzero(scores.max(axis=1) >= reach)[0]}
        if not chosen:
            return
        rows = np.unique(np.concatenate([columns for columns, _ in chosen.values()]))
        ids = dict(zip(rows.tolist(), zip(*(block.column(c).take(pa.array(rows)).to_pylist() for c in ID_COLUMNS))))
        for q, (columns, rounded) in chosen.items():
            found = ((-score, ids[i]) for score, i in zip(rounded.tolist(), columns.tolist()))
            self.best[q] = heapq.nsmallest(self.k, chain(self.best[q], found))
            if len(self.best[q]) == self.k:
                self.floor[q] = -self.best[q][-1][0]

    def _candidates(self, q: int, scores: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Columns that can still enter the top ``k``, and their scores; equal scores all stay, ids decide."""
        columns = np.nonzero(scores >= reach)[0]
        rounded = np.round(scores[columns], SCORE_DECIMALS)
        keep = rounded >= self.floor[q]
        if np.count_nonzero(keep) > self.k:
            keep = rounded >= np.partition(rounded, len(rounded) - self.k)[len(rounded) - self.k]
        return columns[keep], rounded[keep]

    def hits(self, query_index: np.ndarray) -> pa.Table:
        rows = [(int(query_index[q]), *point, -neg) for q, found in enumerate(self.best) for neg, point in found]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        types = (pa.int32(), pa.string(), pa.string(), pa.float64())
        names = ("query_index", *ID_COLUMNS, "score")
        return pa.table({n: pa.array(list(c), type=t) for n, c, t in zip(names, columns, types)})


def _searchable(df: DataFrame, vector: str, dim: int) -> Column:
    return (F.size(vector) == dim) & all_finite(F.col(vector)) & F.exists(vector, lambda x: x != 0)


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """Global rank (from 1) of the hits of each query, best ``k`` kept."""
    best_first = Window.partitionBy("query_index").orderBy(F.desc("score"), *ID_COLUMNS)
    return hits.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def _query_shape(queries: DataFrame) -> tuple[int, int]:
    """Number and size of the queries; queries of several sizes are an error, null vectors find nothing."""
    size = F.when(F.col("qvec").isNotNull(), F.size("qvec"))
    row = queries.agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("dim")).first()
    if row["least"] != row["dim"]:
        raise ValueError(f"The queries have vectors of different sizes, from {row['least']} to {row['dim']}.")
    return row["n"], row["dim"] or 0


def check_queries(queries: DataFrame, dim: int) -> None:
    """Every query must be a vector of the collection's size."""
    wrong = queries.where(F.col("qvec").isNull() | (F.size("qvec") != dim)).select("query_index").limit(1).collect()
    if wrong:
        raise ValueError(f"Query {wrong[0][0]} is no vector of dimension {dim}.")


def knn_exact(points: DataFrame, queries: DataFrame, k: int = 10, broadcast_bytes: int = QUERY_BROADCAST_BYTES,
              most_passes: int = QUERY_PASSES, group: str | None = None) -> DataFrame:
    """Exact top-``k`` of every query over all points: ``(query_index, rank, point_id, tenant, score)``.

    ``points`` has ``tenant, point_id, vector`` and ``queries`` has ``query_index, qvec``. The query set
    is measured first. What exceeds ``broadcast_bytes`` takes several passes over the points, each with
    its share of the queries, which is cheaper than a shuffle of the points; beyond ``most_passes`` the
    blocked plan takes over. With ``group`` each query sees only the points of its group, in the same scan.
    Where many tasks scan, some of them go first and give each query a floor for its last score: about the square root
    of the number of tasks times ``k`` hits of a query are then left to rank, not ``k`` of every task.
    """
    n, dim = _query_shape(queries)
    passes = -(-n * dim * 8 // broadcast_bytes)
    if passes > most_passes:
        return knn_blocked(points, queries, k, group)
    grp = F.col(group) if group else F.lit(0)
    points = points.where(_searchable(points, "vector", dim)).select(*ID_COLUMNS, "vector", grp.alias("grp"))
    queries = queries.where(_searchable(queries, "qvec", dim)).select("query_index", "qvec", grp.alias("grp"))
    share = F.pmod(F.xxhash64("query_index"), F.lit(max(passes, 1)))
    tasks = points.rdd.getNumPartitions() if passes else 0
    found = [
        _scan(points, kept, dim, k, _floors(points, kept, dim, k, tasks) if tasks >= FLOOR_TASKS else None)
        for i in range(passes)
        if (kept := queries.where(share == i if passes > 1 else F.lit(True)).collect())
    ]
    if not found:
        return local_table(points.sparkSession, [], HIT_SCHEMA + ", rank int")
    return rank_hits(reduce(DataFrame.union, found), k).select("query_index", "rank", *ID_COLUMNS, "score")


def _floors(points: DataFrame, queries: list, dim: int, k: int, tasks: int) -> dict[int, float]:
    """The ``k``-th best score of each query among the points of every ``sqrt(tasks)``-th scanning task."""
    first = rank_hits(_scan(points, queries, dim, k, every=isqrt(tasks)), k).where(F.col("rank") == k)
    # One number for each query, as many as are sent to the tasks.
    return {row["query_index"]: row["score"] for row in first.select("query_index", "score").collect()}


def _scan(points: DataFrame, queries: list, dim: int, k: int, floors: dict[int, float] | None = None, every: int = 1) -> DataFrame:
    """Top-``k`` of each scanning task for queries that are sent to all of them; each meets the points of its group.

    Only one of ``every`` tasks reads its points, if that is more than one.
    """
    by_group: dict = {}
    for row in queries:
        by_group.setdefault(row["grp"], []).append(row)
    sets = {}
    for name, rows in by_group.items():
        matrix = np.array([row["qvec"] for row in rows], dtype=np.float64)
        floor = np.array([(floors or {}).get(row["query_index"], -np.inf) for row in rows])
        sets[name] = np.array([row["query_index"] for row in rows]), matrix / np.linalg.norm(matrix, axis=1, keepdims=True), floor
    shared = points.sparkSession.sparkContext.broadcast(sets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if every > 1 and TaskContext.get().partitionId() % every:
            return
        best = {name: (index, _TopK(matrix, k, floor)) for name, (index, matrix, floor) in shared.value.items()}
        for batch in batches:
            groups = batch.column("grp").dictionary_encode()
            codes = groups.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(groups.dictionary.to_pylist()):
                if name not in best:
                    continue
                index, top = best[name]
                here = batch if len(groups.dictionary) == 1 and not groups.null_count else batch.take(pa.array(np.flatnonzero(codes == code)))
                rows_at_once = max(1, SCORE_CELLS // len(index))
                for start in range(0, here.num_rows, rows_at_once):
                    top.add(here.slice(start, rows_at_once))
        for index, top in best.values():
            yield from top.hits(index).to_batches()

    return points.mapInArrow(scan, HIT_SCHEMA)


def _stretches(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[list, pa.RecordBatch]]:
    """Runs of neighbouring rows that agree in the columns ``names``, each with their values."""
    codes = [batch.column(name).dictionary_encode().indices.to_numpy(zero_copy_only=False) for name in names]
    cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
    for first, end in pairwise([0, *cuts.tolist(), batch.num_rows]):
        if first < end:
            yield [batch.column(name)[first].as_py() for name in names], batch.slice(first, end - first)


def knn_blocked(points: DataFrame, queries: DataFrame, k: int = 10, group: str | None = None,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact top-``k`` by blocks; with ``group``, each query sees only the points of its group.

    A group is cut into as many blocks of points as its size asks for, so neither a hot group nor a large query set has to
    fit in a task. Every point moves to its block once; the queries of the group are what is copied, once for each block.
    Behind the shuffle a task holds the points of one block and lets the queries pass by a batch at a time; each meeting
    returns at most ``k`` hits for a query.
    """
    _, dim = _query_shape(queries)
    if dim == 0:
        return local_table(points.sparkSession, [], HIT_SCHEMA + ", rank int")
    block_rows = max(1, block_bytes // (dim * 8))
    points = points.where(_searchable(points, "vector", dim))
    queries = queries.where(_searchable(queries, "qvec", dim))
    blocks = F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")

    if group is None:
        total = points.agg(blocks).first()["blocks"]
        p, q = (df.withColumns({"grp": F.lit(0), "blocks": F.lit(max(total, 1))}) for df in (points, queries))
    else:
        asked = queries.select(F.col(group).alias("grp")).distinct()
        sizes = materialize(points.groupBy(F.col(group).alias("grp")).agg(blocks).join(asked, "grp", "left_semi"), "sizes")
        total = sizes.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks")).first()["blocks"]
        sizes = local_if_small(sizes)
        p, q = (df.withColumn("grp", F.col(group)).join(sizes, "grp") for df in (points, queries))

    place = F.pmod(F.xxhash64(*ID_COLUMNS), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = p.select("grp", place.alias("block"), F.lit(0).alias("role"), *ID_COLUMNS, "vector").unionByName(
        q.select("grp", every.alias("block"), F.lit(1).alias("role"), "query_index", "qvec"), allowMissingColumns=True)
    # A number of partitions of its own: blocks are small in bytes for the work they mean, so they are not put together.
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(total, MOST_PARTITIONS))
    dealt = met.repartition(parts, "grp", "block").sortWithinPartitions("grp", "block", "role")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        here: list | None = None
        for batch in batches:
            for (*block, role), rows in _stretches(batch, ("grp", "block", "role")):
                if block != here:
                    held, here = [], block
                if role == 0:
                    held.append(rows)
                    continue
                best = _TopK(_matrix(rows.column("qvec"), dim), k)
                step = max(1, SCORE_CELLS // rows.num_rows)
                for some in held:
                    for start in range(0, some.num_rows, step):
                        best.add(some.slice(start, step))
                yield from best.hits(rows.column("query_index").to_numpy(zero_copy_only=False)).to_batches()

    found = dealt.mapInArrow(meet, HIT_SCHEMA)
    return rank_hits(found, k).select("query_index", "rank", *ID_COLUMNS, "score")


def knn_tenant(points: DataFrame, queries: DataFrame, k: int = 10, tenant: str | None = None) -> DataFrame:
    """Top-``k`` inside one tenant, or inside each query's own ``tenant`` column."""
    if tenant is not None:
        return knn_exact(points.where(F.col("tenant") == tenant), queries, k)
    return knn_exact(points, queries, k, group="tenant")


def normalize_vectors(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.withColumn(vector, normalize(F.col(vector)))


def _nearest_cells(vector: Column, centroids: np.ndarray, n: int) -> Column:
    """The ``n`` cells whose centroids are closest, nearest first (ties by cell number)."""
    dim = centroids.shape[1]
    unit = centroids / np.linalg.norm(centroids, axis=1, keepdims=True)
    # A share of the centroids at a time, and the best cells so far: the scores of a batch stay small.
    share = max(n, SCORE_CELLS // 10_000)

    @F.arrow_udf("array<int>")
    def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            vectors = _matrix(batch, dim)
            nearest = np.zeros((len(vectors), 0), np.int32)
            best = np.zeros((len(vectors), 0))
            for first in range(0, len(unit), share):
                some = np.round(vectors @ unit[first : first + share].T, SCORE_DECIMALS)
                number = np.broadcast_to(np.arange(first, first + some.shape[1], dtype=np.int32), some.shape)
                best, nearest = np.hstack((best, some)), np.hstack((nearest, number))
                order = np.argsort(-best, axis=1, kind="stable")[:, :n]
                best, nearest = np.take_along_axis(best, order, 1), np.take_along_axis(nearest, order, 1)
            offsets = np.arange(0, nearest.size + 1, nearest.shape[1], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(nearest.ravel()))

    return cells(vector)


def train_centroids(points: DataFrame, cells: int, seed: int = 42, iterations: int = 10) -> list[list[float]]:
    """Centroids by Spark's own k-means over unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = points.select(normalize(F.col("vector")).alias("v")).where(F.col("v").isNotNull())
    model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(unit.select(array_to_vector("v").alias("features")))
    return [[float(x) for x in center] for center in model.clusterCenters()]


def assign_cells(df: DataFrame, centroids: list[list[float]], vector: str = "vector", probes: int = 1) -> DataFrame:
    """Add ``cell``: one row for each of the ``probes`` nearest centroids."""
    matrix = np.array(centroids, dtype=np.float64)
    usable = df.where(_searchable(df, vector, matrix.shape[1]))
    return usable.withColumn("cell", F.explode(_nearest_cells(F.col(vector), matrix, min(probes, len(matrix)))))


def place_in_cells(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """Add ``cell``, the nearest centroid, to every point; null for vectors that no search finds."""
    matrix = np.array(centroids, dtype=np.float64)
    usable = F.when(_searchable(points, "vector", matrix.shape[1]), F.col("vector"))
    # Null vectors stand for those without a cell; their place in the batch is filled and ignored.
    filled = F.coalesce(usable, F.array_repeat(F.lit(0.0), matrix.shape[1]).cast(points.schema["vector"].dataType))
    return points.withColumn("cell", F.when(usable.isNotNull(), F.get(_nearest_cells(filled, matrix, 1), F.lit(0))))


def build_ivf(points: DataFrame, centroids: list[list[float]], path: str, *columns: str) -> DataFrame:
    """Write the points once, one folder for each cell, and return that table.

    A search then opens the folders of the cells it probes and no other. Rebalancing splits large cells
    over several files.
    """
    placed = assign_cells(points, centroids).select("cell", *ID_COLUMNS, "vector", *columns)
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    return points.sparkSession.read.schema(placed.schema).parquet(path)


def knn_ivf(points: DataFrame, queries: DataFrame, centroids: list[list[float]], k: int = 10,
            probes: int = 2) -> DataFrame:
    """Approximate top-``k``: each query searches only its ``probes`` nearest cells.

    ``points`` is a table of :func:`build_ivf`; plain points are placed while searching. With as many
    probes as cells the result is exact.
    """
    placed = points if "cell" in points.columns else assign_cells(points, centroids)
    asked = assign_cells(queries, centroids, "qvec", probes)
    # At most one row for each centroid.
    probed = [row["cell"] for row in asked.select("cell").distinct().collect()]
    return knn_exact(placed.where(F.col("cell").isin(probed)), asked, k, group="cell")


def attach_payload(hits: DataFrame, points: DataFrame, columns: list[str], most_hits: int | None = None) -> DataFrame:
    """Join columns of the points to the hits, after ranking, so only the hits carry them.

    ``most_hits`` is the known upper bound (queries times k); within the limit the hits are broadcast
    and the points are not shuffled.
    """
    side = F.broadcast(hits) if most_hits is not None and most_hits <= HITS_BROADCAST_ROWS else hits
    return points.select(*ID_COLUMNS, *columns).join(side, list(ID_COLUMNS))


def scroll_page(points: DataFrame, limit: int = 256, after: tuple[str, str] | None = None) -> DataFrame:
    """The next ``limit`` points by point id and tenant, after the last ``(point_id, tenant)`` of the page before.

    Both are needed: one id may occur in many tenants.
    """
    if after is not None:
        point, tenant = after
        points = points.where((F.col("point_id") > point) | ((F.col("point_id") == point) & (F.col("tenant") > tenant)))
    return points.orderBy(*ID_COLUMNS).limit(limit)


def number_pages(points: DataFrame, limit: int = 256) -> DataFrame:
    """Every point with the number of its page (from 0) when all are read in the order of :func:`scroll_page`.

    Points are dealt by ranges of their ids and written once; one count for each range then places them all.
    """
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = points.repartitionByRange(parts, *ID_COLUMNS).sortWithinPartitions(*ID_COLUMNS)
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "pages")
    # The high bits of such a number are the range, the low 33 bits the place in it.
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    seen, starts = 0, []
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((row["part"], seen))
        seen += row["count"]
    before = F.broadcast(local_table(points.sparkSession, starts, "_part bigint, _before bigint"))
    numbered = placed.withColumn("_part", part).join(before, "_part")
    return numbered.withColumn("page", F.floor((F.col("_before") + at) / limit).cast("bigint")).drop("_part", "_before", "_at")
