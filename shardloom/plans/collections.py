"""Versioned collections of points on Parquet.

A collection is a folder: ``_meta.json`` holds its fixed properties, each ``_versions/<n>.json`` lists
the partitions of one version, and ``data/commit=<id>/tenant=<t>/bucket=<b>/`` holds their rows. A
commit writes into a folder of its own and becomes visible when its version file is created. Nothing that
a reader may be reading is overwritten, and an old version is a snapshot for free. One writer at a time.

An upsert writes the rows that arrive. A partition may so lie in several commits: of a key, the row of the
last commit counts, and readers drop the others by the keys of the later commits, which are few. A
partition is written anew as a whole when these layers have grown to a share of its points, or by
:meth:`CollectionStore.compact`. With :meth:`CollectionStore.set_cells` rows lie in one folder more,
``cell=<c>``, by the nearest of the collection's centroids; an approximate search opens the cells it probes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.vectors import all_finite
from shardloom.operators.joins import snapshot_restore
from shardloom.operators.prepare import stamp_tenant
from shardloom.operators.reports import dedupe_last
from shardloom.operators.search import place_in_cells
from shardloom.session import local_table
from shardloom.sources import files
from shardloom.sources.backup import DEFAULT_LABEL

KEYS = ["tenant", "point_id"]

# A partition is folded when it has so many layers, or when those above the first hold this share of its points.
MOST_LAYERS = 8
LAYER_SHARE = 0.25
# Keys of later layers are sent to all readers up to this number, which the version file knows; beyond, rows are joined.
BROADCAST_KEYS = 1_000_000
# Centroids are sent to all tasks, as doubles.
CENTROID_BYTES = 64 << 20
POINT_COLUMNS = "point_id string, vector array<float>, payload variant, seq bigint"


class RejectedLoad(ValueError):
    """A load with points that the collection cannot take; nothing was written."""


@dataclass(frozen=True)
class Collection:
    """Fixed properties. ``promoted`` payload keys are stored as columns, so filters on them push down."""

    name: str
    vector_size: int
    partitioned: bool = True
    buckets: int = 16
    promoted: tuple[str, ...] = ()
    distance: str = "cosine"


@dataclass
class Version:
    number: int = 0
    tenants: list[str] = field(default_factory=list)
    # tenant, bucket, commit folder, points, bytes; in the order of commits
    partitions: list[list] = field(default_factory=list)
    # last micro-batch committed by each stream
    streams: dict[str, int] = field(default_factory=dict)
    # name of the centroids by which all partitions are laid out, or nothing
    cells: str = ""

    def layers(self) -> dict[tuple[str, int], list[list]]:
        """The entries of each partition, in the order of commits."""
        found: dict[tuple[str, int], list[list]] = {}
        for entry in self.partitions:
            found.setdefault((entry[0], entry[1]), []).append(entry)
        return found


@dataclass(frozen=True)
class EnsureResult:
    collection: str
    collection_created: bool
    created: list[str]
    skipped: list[str]


def _is_due(layers: list[list], arriving: int) -> bool:
    """Whether one layer more is too much for a partition."""
    if not layers:
        return False
    above = sum(entry[3] for entry in layers[1:]) + arriving
    return len(layers) >= MOST_LAYERS or above > LAYER_SHARE * layers[0][3]


class CollectionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- metadata -----------------------------------------------------------------------------

    def _path(self, name: str, *parts: str) -> str:
        return "/".join([self.root, name, *parts])

    def exists(self, name: str) -> bool:
        return files.exists(self.spark, self._path(name, "_meta.json"))

    def names(self) -> list[str]:
        return [name for name in files.list_names(self.spark, self.root) if self.exists(name)]

    def describe(self, name: str) -> Collection:
        if not self.exists(name):
            raise ValueError(f"Collection {name!r} does not exist.")
        values = json.loads(files.read_text(self.spark, self._path(name, "_meta.json")))
        return Collection(**{**values, "promoted": tuple(values["promoted"])})

    def version_numbers(self, name: str) -> list[int]:
        listed = files.list_names(self.spark, self._path(name, "_versions"))
        return sorted(int(n.removesuffix(".json")) for n in listed if n.endswith(".json") and not n.startswith("."))

    def version(self, name: str, number: int | None = None) -> Version:
        self.describe(name)
        if number is None:
            number = self.version_numbers(name)[-1]
        return Version(**json.loads(files.read_text(self.spark, self._path(name, "_versions", f"{number}.json"))))

    def tenants(self, name: str) -> list[str]:
        return self.version(name).tenants

    def registry(self) -> DataFrame:
        """Rows ``(collection, tenant)`` of every registered tenant."""
        pairs = [(name, tenant) for name in self.names() for tenant in self.tenants(name)]
        return local_table(self.spark, pairs, "collection string, tenant string")

    def _commit(self, name: str, version: Version) -> Version:
        version.number += 1
        path = self._path(name, "_versions", f"{version.number}.json")
        files.publish_text(self.spark, path, json.dumps(asdict(version)))
        return version

    # -- collections and tenants ----------------------------------------------------------------

    def ensure(self, name: str, tenants: Iterable[str] = (), vector_size: int = 1024, force_recreate: bool = False,
               buckets: int = 16, promoted: Iterable[str] = ()) -> EnsureResult:
        """Create what is missing. Asking for tenants on an unpartitioned collection is an error."""
        asked = {str(t): None for t in tenants if str(t)}  # a dict keeps the order of the request
        held = self.describe(name) if self.exists(name) else None
        flat = held is not None and not held.partitioned
        if flat and asked and not force_recreate:
            raise RuntimeError(f"{name!r} was made without tenants and cannot take {len(asked)}; force_recreate drops its points.")
        if flat and asked:
            self.delete_collection(name)
            held = None
        if held is None:
            meta = Collection(name, vector_size, bool(asked), buckets, tuple(promoted))
            files.write_text(self.spark, self._path(name, "_meta.json"), json.dumps(asdict(meta)))
            version = self._commit(name, Version())
        else:
            version = self.version(name)
        report = EnsureResult(name, held is None, [t for t in asked if t not in version.tenants], [t for t in asked if t in version.tenants])
        if report.created:
            version.tenants = sorted([*version.tenants, *report.created])
            self._commit(name, version)
        return report

    def delete_tenants(self, name: str, tenants: Iterable[str]) -> tuple[list[str], list[str]]:
        """Drop the partitions of the tenants in a new version; returns (deleted, skipped)."""
        version = self.version(name)
        requested = list(dict.fromkeys(tenants))
        deleted = [t for t in requested if t in set(version.tenants)]
        if deleted:
            gone = set(deleted)
            version.tenants = [t for t in version.tenants if t not in gone]
            version.partitions = [p for p in version.partitions if p[0] not in gone]
            self._commit(name, version)
        return deleted, [t for t in requested if t not in set(deleted)]

    def delete_collection(self, name: str) -> bool:
        return self.exists(name) and files.delete_tree(self.spark, self._path(name))

    # -- points -----------------------------------------------------------------------------------

    def _schema(self, meta: Collection, celled: bool) -> str:
        promoted = "".join(f", `{key}` string" for key in meta.promoted)
        return f"{POINT_COLUMNS}{promoted}, commit string, tenant string, bucket int{', cell int' * celled}"

    def _files(self, meta: Collection, partitions: list[list], celled: bool) -> DataFrame:
        """The rows of these partitions with their commit, all layers."""
        schema = self._schema(meta, celled)
        if not partitions:
            return self.spark.createDataFrame([], schema)
        base = self._path(meta.name, "data")
        commits: dict[str, set] = {}
        for tenant, bucket, commit, *_ in partitions:
            commits.setdefault(commit, set()).add((tenant, bucket))
        df = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/commit={c}" for c in commits])
        # Partition columns only: Spark drops the folders of other versions before it opens a file.
        live = F.lit(False)
        for commit, keys in commits.items():
            by_tenant: dict[str, list[int]] = {}
            for tenant, bucket in keys:
                by_tenant.setdefault(tenant, []).append(bucket)
            same: dict[tuple[int, ...], list[str]] = {}
            for tenant, buckets in by_tenant.items():
                same.setdefault(tuple(sorted(buckets)), []).append(tenant)
            for buckets, names in same.items():
                live = live | ((F.col("commit") == commit) & F.col("tenant").isin(names) & F.col("bucket").isin(*buckets))
        return df.where(live)

    def _read(self, meta: Collection, partitions: list[list], cells: str = "") -> DataFrame:
        """The points of these partitions: of a key, the row of the last commit."""
        celled = bool(cells)
        layers = Version(partitions=partitions).layers()
        single = [entries[0] for entries in layers.values() if len(entries) == 1]
        stacked = [entry for entries in layers.values() if len(entries) > 1 for entry in entries]
        plain = self._files(meta, single, celled).drop("commit")
        if not stacked:
            return plain
        number = F.split("commit", "-")[0].cast("int")
        above = [entry for entries in layers.values() for entry in entries[1:]]
        # Keys of the later layers only: narrow, and few by LAYER_SHARE. A row of a cell may be replaced by one of another.
        later = self._files(meta, above, celled).groupBy(
            F.col("tenant").alias("_tenant"), F.col("point_id").alias("_point")).agg(F.max(number).alias("_last"))
        if sum(entry[3] for entry in above) <= BROADCAST_KEYS:
            later = F.broadcast(later)
        rows = self._files(meta, stacked, celled)
        on = (F.col("tenant") == F.col("_tenant")) & (F.col("point_id") == F.col("_point"))
        current = rows.withColumn("_number", number).join(later, on & (F.col("_number") < F.col("_last")), "left_anti")
        return plain.unionByName(current.drop("commit", "_number"))

    def points(self, name: str, tenant: str | None = None, version: int | None = None, cells: list[int] | None = None) -> DataFrame:
        """Stored points of a version (the last by default), of one tenant or all.

        ``cells`` opens these cells only and keeps the column ``cell``.
        """
        meta, state = self.describe(name), self.version(name, version)
        partitions = [p for p in state.partitions if tenant is None or p[0] == tenant]
        found = self._read(meta, partitions, state.cells).drop("bucket")
        if cells is None:
            return found.drop("cell")
        if not state.cells:
            raise ValueError(f"Collection {name!r} has no cells; set_cells lays it out by centroids.")
        return found.where(F.col("cell").isin(list(map(int, cells))))

    def points_beside(self, name: str, hits: DataFrame) -> DataFrame:
        """The stored points of the partitions that any of the hits (tenant, point_id) lies in; no other file is opened."""
        meta, state = self.describe(name), self.version(name)
        # At most one row for each partition comes back.
        asked = hits.select("tenant", self._bucket(meta).alias("bucket")).distinct().limit(len(state.partitions) + 1).collect()
        wanted = {(row["tenant"], row["bucket"]) for row in asked}
        return self._read(meta, [p for p in state.partitions if (p[0], p[1]) in wanted], state.cells).drop("bucket", "cell")

    # -- cells --------------------------------------------------------------------------------------

    def set_cells(self, name: str, centroids: list[list[float]]) -> Version:
        """Lay the whole collection out by the nearest centroid; later commits follow. Rewrites every point once."""
        meta, version = self.describe(name), self.version(name)
        if not centroids or any(len(c) != meta.vector_size for c in centroids):
            raise ValueError(f"Centroids of {name!r} need vectors of {meta.vector_size}.")
        if len(centroids) * meta.vector_size * 8 > CENTROID_BYTES:
            raise ValueError(f"{len(centroids)} centroids of {meta.vector_size} are more than {CENTROID_BYTES >> 20} MB.")
        rows = self._read(meta, version.partitions, version.cells).drop("cell")
        version.cells = uuid.uuid4().hex
        files.write_text(self.spark, self._path(name, "_cells", f"{version.cells}.json"), json.dumps(centroids))
        return self._write(meta, version, rows, {(p[0], p[1]) for p in version.partitions})

    def centroids(self, name: str, version: Version | None = None) -> list[list[float]]:
        """The centroids of a version, in cell order; empty without cells."""
        cells = (version or self.version(name)).cells
        return json.loads(files.read_text(self.spark, self._path(name, "_cells", f"{cells}.json"))) if cells else []

    def _bucket(self, meta: Collection) -> Column:
        return F.pmod(F.xxhash64("point_id"), F.lit(meta.buckets)).cast("int")

    def _conform(self, meta: Collection, points: DataFrame, order: list[str]) -> DataFrame:
        # Without tenants the point id alone is the key, and the payload keeps the tenant.
        tenant = F.col("tenant") if meta.partitioned else F.lit(DEFAULT_LABEL)
        payload = F.col("payload") if "payload" in points.columns else F.lit(None).cast("variant")
        if not meta.partitioned and "tenant" in points.columns:
            payload = stamp_tenant(payload, F.nullif(F.col("tenant"), F.lit(DEFAULT_LABEL)))
        seq = F.col("seq").cast("bigint") if "seq" in points.columns else F.lit(None).cast("bigint")
        return points.select(
            tenant.alias("tenant"),
            "point_id",
            F.col("vector").cast("array<float>").alias("vector"),
            payload.alias("payload"),
            seq.alias("seq"),
            *[
                (F.col(key) if key in points.columns else F.try_variant_get(payload, f"$['{key}']", "string")).alias(key)
                for key in meta.promoted
            ],
            F.struct(*order).alias("_order"),
            self._bucket(meta).alias("bucket"),
        )

    def _check(self, meta: Collection, staged: DataFrame, tenants: list[str]) -> dict[tuple[str, int], int]:
        """Staged points of each partition they touch; a bad load stops here, before any commit.

        One pass. Only registered tenants may appear, so at most tenants times buckets rows come back.
        """
        wrong_size = F.size("vector") != meta.vector_size
        known = set(tenants) if meta.partitioned else {DEFAULT_LABEL}
        rows = (
            staged.groupBy("tenant", "bucket")
            .agg(
                F.count("*").alias("n"),
                F.count_if(F.col("vector").isNull()).alias("missing"),
                F.count_if(wrong_size).alias("wrong"),
                F.max(F.when(wrong_size, F.size("vector"))).alias("size"),
                F.count_if(F.col("point_id").isNull()).alias("nameless"),
                F.count_if(~wrong_size & ~all_finite(F.col("vector"))).alias("unbounded"),
            )
            .limit(len(known) * meta.buckets + 1)
            .collect()
        )
        unknown = sorted({str(row["tenant"]) for row in rows} - known)
        if unknown:
            raise RejectedLoad(f"Tenant(s) not registered on collection {meta.name!r}: {unknown[:5]}")
        nameless = sum(row["nameless"] for row in rows)
        if nameless:
            raise RejectedLoad(f"{nameless} point(s) have no id.")
        unbounded = sum(row["unbounded"] for row in rows)
        if unbounded:
            raise RejectedLoad(f"{unbounded} point(s) have a vector that is not finite in single precision.")
        missing = sum(row["missing"] for row in rows)
        if missing:
            raise RejectedLoad(f"{missing} point(s) have no vector.")
        wrong = sum(row["wrong"] for row in rows)
        if wrong:
            sizes = [row["size"] for row in rows if row["size"] is not None]
            raise RejectedLoad(
                f"{wrong} point(s) have another vector size (for example {sizes[:1]}) than collection "
                f"{meta.name!r}, which expects {meta.vector_size}."
            )
        return {(row["tenant"], row["bucket"]): row["n"] for row in rows}

    def _write(self, meta: Collection, version: Version, rows: DataFrame, replaced: set[tuple[str, int]]) -> Version:
        """Write rows as the last layer of their partitions and commit; ``replaced`` partitions lose their former layers."""
        commit = f"{version.number + 1}-{uuid.uuid4().hex[:12]}"
        path = self._path(meta.name, "data", f"commit={commit}")
        layout = ["tenant", "bucket"]
        if version.cells:
            rows = place_in_cells(rows, self.centroids(meta.name, version))
            layout.append("cell")
        # Rebalancing gives each partition few files and splits the ones that are large.
        (
            rows.hint("rebalance", *layout)
            .sortWithinPartitions(*layout, "point_id")
            .write.partitionBy(*layout)
            .parquet(path)
        )
        schema = self._schema(meta, bool(version.cells))
        written = self.spark.read.schema(schema).option("basePath", self._path(meta.name, "data")).parquet(path)
        # Row counts and sizes come from the file footers; one row for each written partition returns.
        file = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")
        counts = (
            written.select("tenant", "bucket", *file)
            .groupBy("tenant", "bucket", "file").agg(F.count("*").alias("points"), F.max("size").alias("bytes"))
            .groupBy("tenant", "bucket").agg(F.sum("points").alias("points"), F.sum("bytes").alias("bytes"))
            .collect()
        )
        version.partitions = [p for p in version.partitions if (p[0], p[1]) not in replaced] + [
            [r["tenant"], r["bucket"], commit, r["points"], r["bytes"]] for r in counts
        ]
        return self._commit(meta.name, version)

    def upsert(self, name: str, points: DataFrame, order: list[str] = ("seq",), newer_only: bool = False,
               stream: tuple[str, int] | None = None) -> int:
        """Insert or replace whole points by ``(tenant, point_id)``; returns the number of points read.

        Inside one load the row with the largest ``order`` wins. ``newer_only`` also keeps a stored
        point whose ``seq`` is greater. ``stream`` is a stream's name and micro-batch number: a batch
        that was committed before is skipped. Stored points are not written again unless their
        partition is due to be folded.
        """
        meta, version = self.describe(name), self.version(name)
        if stream and version.streams.get(stream[0], -1) >= stream[1]:
            return 0
        # Staged once, so that parsing and embedding run once however many passes follow.
        staging = self._path(name, "_staging", uuid.uuid4().hex)
        self._conform(meta, points, list(order)).write.parquet(staging)
        staged = self.spark.read.parquet(staging)
        try:
            arriving = self._check(meta, staged, version.tenants)
        except RejectedLoad:
            files.delete_tree(self.spark, staging)
            raise
        if stream:
            version.streams[stream[0]] = stream[1]
        if arriving:
            incoming = dedupe_last(staged, KEYS, ["_order"]).drop("_order")
            layers = version.layers()
            touched = [p for p in version.partitions if (p[0], p[1]) in arriving]
            if newer_only:
                stored = self._read(meta, touched, version.cells).select(*KEYS, F.col("seq").alias("_seq"))
                newer = incoming.select(*KEYS, "seq").join(stored, KEYS).where(F.col("_seq") > F.col("seq")).select(*KEYS)
                incoming = incoming.join(newer, KEYS, "left_anti")
            folded = {key for key, n in arriving.items() if _is_due(layers.get(key, []), n)}
            if folded:
                kept = self._read(meta, [p for p in touched if (p[0], p[1]) in folded], version.cells).drop("cell")
                incoming = kept.join(incoming.select(*KEYS), KEYS, "left_anti").unionByName(incoming)
            self._write(meta, version, incoming, folded)
        elif stream:
            self._commit(name, version)
        files.delete_tree(self.spark, staging)
        return sum(arriving.values())

    def compact(self, name: str) -> int:
        """Write every partition that has several layers anew as one; returns how many there were."""
        meta, version = self.describe(name), self.version(name)
        stacked = {key for key, entries in version.layers().items() if len(entries) > 1}
        if stacked:
            rows = self._read(meta, [p for p in version.partitions if (p[0], p[1]) in stacked], version.cells)
            self._write(meta, version, rows.drop("cell"), stacked)
        return len(stacked)

    def replace(self, name: str, points: DataFrame) -> Version:
        """Make ``points`` (the columns of :meth:`points`) the whole content in a new version."""
        meta, version = self.describe(name), self.version(name)
        rows = points.withColumn("bucket", self._bucket(meta))
        tenants = points.select("tenant").distinct().collect() if meta.partitioned else []
        version.tenants = sorted(set(version.tenants) | {r["tenant"] for r in tenants})
        return self._write(meta, version, rows, {(p[0], p[1]) for p in version.partitions})

    # -- snapshots --------------------------------------------------------------------------------

    def create_snapshot(self, name: str, label: str | None = None) -> str:
        """Name the current version so that it is kept; no data is copied."""
        number = self.version(name).number
        label = label or f"{name}-{number}-{uuid.uuid4().hex[:8]}"
        record = {"version": number, "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}
        files.write_text(self.spark, self._path(name, "_snapshots", f"{label}.json"), json.dumps(record))
        return label

    def _snapshot(self, name: str, label: str) -> dict:
        return json.loads(files.read_text(self.spark, self._path(name, "_snapshots", f"{label}.json")))

    def _snapshot_labels(self, name: str) -> list[str]:
        listed = files.list_names(self.spark, self._path(name, "_snapshots"))
        return [n.removesuffix(".json") for n in listed if n.endswith(".json") and not n.startswith(".")]

    def _count(self, name: str, version: Version) -> int:
        """Points of a version: from its list, but for partitions of several layers, whose keys are counted."""
        layers = version.layers().values()
        stacked = [p for entries in layers if len(entries) > 1 for p in entries]
        noted = sum(entries[0][3] for entries in layers if len(entries) == 1)
        return noted + (self._read(self.describe(name), stacked, version.cells).count() if stacked else 0)

    def list_snapshots(self, name: str) -> DataFrame:
        """Rows ``(snapshot, created_at, version, tenants, points, bytes)``."""
        rows = []
        for label in self._snapshot_labels(name):
            record = self._snapshot(name, label)
            version = self.version(name, record["version"])
            size = sum(p[4] for p in version.partitions)
            rows.append((label, record["created_at"], version.number, len(version.tenants), self._count(name, version), size))
        return local_table(
            self.spark, rows, "snapshot string, created_at string, version int, tenants int, points bigint, bytes bigint"
        )

    def restore_snapshot(self, name: str, label: str, priority: str = "snapshot", source: str | None = None) -> Version:
        """Merge a snapshot (of ``source``, or of the collection itself) into the current points."""
        origin = source or name
        here, there = self.describe(name), self.describe(origin)
        if there.vector_size != here.vector_size:
            raise ValueError(f"{origin!r} has vectors of {there.vector_size}, {name!r} expects {here.vector_size}.")
        number = self._snapshot(origin, label)["version"]
        if origin != name:
            saved = self._conform(here, self.points(origin, version=number).drop(*there.promoted), ["seq"])
            return self.replace(name, snapshot_restore(saved.drop("_order", "bucket"), self.points(name), priority))
        # Partitions that both versions share, with all their layers, need no work.
        then, now = self.version(name, number), self.version(name)
        names = [{key: [p[2] for p in entries] for key, entries in v.layers().items()} for v in (then, now)]
        same = {key for key, commits in names[0].items() if names[1].get(key) == commits}
        before, after = ([p for p in v.partitions if (p[0], p[1]) not in same] for v in (then, now))
        saved, current = (self._read(here, p, v.cells).drop("bucket", "cell") for p, v in ((before, then), (after, now)))
        merged = snapshot_restore(saved, current, priority)
        if here.partitioned:
            now.tenants = sorted(set(now.tenants) | {p[0] for p in before})
        return self._write(here, now, merged.withColumn("bucket", self._bucket(here)), {(p[0], p[1]) for p in after})

    def vacuum(self, name: str, keep_versions: int = 1) -> list[str]:
        """Delete commit folders that neither the last versions nor a snapshot refer to."""
        numbers = self.version_numbers(name)
        kept = set(numbers[-keep_versions:])
        kept |= {self._snapshot(name, label)["version"] for label in self._snapshot_labels(name)}
        live = {p[2] for number in kept for p in self.version(name, number).partitions}
        dropped = []
        for folder in files.list_names(self.spark, self._path(name, "data")):
            if folder.startswith("commit=") and folder.removeprefix("commit=") not in live:
                files.delete_tree(self.spark, self._path(name, "data", folder))
                dropped.append(folder)
        for number in numbers:
            if number not in kept:
                files.delete_tree(self.spark, self._path(name, "_versions", f"{number}.json"))
        return dropped
