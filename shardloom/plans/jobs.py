"""The user-level jobs: load, embed, search, back up and restore."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from shardloom.functions.text import is_blank, trim_ws
from shardloom.operators import chunk, embed, prepare, search
from shardloom.operators.joins import label_results, replace_tenant_slice
from shardloom.operators.validate import import_violations
from shardloom.plans.collections import CollectionStore, EnsureResult, RejectedLoad
from shardloom.session import local_table, materialize
from shardloom.sinks import writers
from shardloom.sources.backup import read_manifest, scan_backup
from shardloom.sources.csv import scan_csv
from shardloom.sources.registry import read_registry

# A step that adds a vector column, such as embed_by_hash or embed_text with its arguments bound.
EmbedStep = Callable[[DataFrame], DataFrame]


def _require_tenant(store: CollectionStore, collection: str, tenant: str) -> None:
    known = store.tenants(collection)
    if known and tenant not in known:
        raise ValueError(f"Tenant {tenant!r} is not registered on {collection!r}. Known: {known[:15]}")


def _tenant_points(store: CollectionStore, collection: str, tenant: str | None) -> DataFrame:
    """One tenant's points: its partitions or, without tenant partitions, the payload field."""
    if tenant is None or store.describe(collection).partitioned:
        return store.points(collection, tenant)
    return prepare.match_filter(store.points(collection), {"tenant_name": tenant})


class Loaded(int):
    """The number of points that a load wrote, with ``read``, the rows of its files, and ``dropped``, rows by reason."""

    read: int
    dropped: dict[str, int]


def _loaded(points: int, seen: Observation, *more: Observation) -> Loaded:
    """What the observations counted while the points were staged; rows are counted under their first reason."""
    counts = {key: value for observation in (seen, *more) for key, value in observation.get.items()}
    report = Loaded(points)
    report.read = counts.pop("read")
    report.dropped = counts
    return report


def _tenant_reason(rows: DataFrame, tenant: str | None, field: str, trim: bool) -> Column:
    """Whether a row is another tenant's; without a tenant every row that names one is loaded."""
    value = trim_ws(F.col(field)) if trim else F.col(field)
    return F.coalesce(value, F.lit("")) == "" if tenant is None else ~value.eqNullSafe(F.lit(tenant))


def prepare_points(rows: DataFrame, tenant: str | Column, vector: str = "embedding", drop: Sequence[str] = ("embedding",),
                   stamp_field: str | None = None) -> DataFrame:
    """Rows with a vector and ``row_pos`` as points: id from uid or ordinal, payload from the other columns."""
    name = F.lit(tenant) if isinstance(tenant, str) else tenant
    payload = prepare.payload_object(rows, (*drop, "row_pos"), {stamp_field: name} if stamp_field else None)
    keyed = prepare.assign_point_ids(rows)
    return keyed.select(
        name.alias("tenant"), "point_id", F.col(vector).alias("vector"), payload.alias("payload"),
        F.col("row_pos").alias("seq"),
    )


def ingest_csv(store: CollectionStore, collection: str, tenant: str | None, path: str, tenant_field: str = "org_id",
               multi_line: bool = True) -> Loaded:
    """Load the rows of one tenant, or of all (None), with their stored vectors; rows without a usable vector are dropped."""
    if tenant is not None:
        _require_tenant(store, collection, tenant)
    rows = scan_csv(store.spark, path, [tenant_field, "embedding"], multi_line, ordinal="row_pos")
    other = _tenant_reason(rows, tenant, tenant_field, trim=False)
    seen, embedded = Observation(), Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(other).alias("other_tenant")).where(~other)
    rows = prepare.parse_vectors(rows, keep_failures=True)
    usable = F.coalesce(F.size("embedding") > 0, F.lit(False))
    rows = rows.observe(embedded, F.count_if(~usable).alias("no_vector")).where(usable)
    # A collection without tenants keeps the tenant in the payload, where its search and export look for it.
    stamp = None if store.describe(collection).partitioned else "tenant_name"
    name = F.col(tenant_field) if tenant is None else tenant
    return _loaded(store.upsert(collection, prepare_points(rows, name, stamp_field=stamp)), seen, embedded)


def embed_upsert_csv(store: CollectionStore, collection: str, tenant: str | None, path: str, embedder: EmbedStep,
                     tenant_field: str = "org_id", text_field: str = "text", stamp_field: str = "tenant_name",
                     multi_line: bool = True) -> Loaded:
    """Embed the rows of one tenant, or of all (None), while loading them. ``embedder`` adds ``embedding``.

    Rows with blank text, or whose text gets no vector, are dropped and counted.
    """
    if tenant is not None:
        _require_tenant(store, collection, tenant)
    rows = scan_csv(store.spark, path, [tenant_field], multi_line, ordinal="row_pos").drop("embedding")
    other, blank = _tenant_reason(rows, tenant, tenant_field, trim=True), is_blank(F.col(text_field))
    seen, embedded = Observation(), Observation()
    counts = F.count_if(other).alias("other_tenant"), F.count_if(~other & blank).alias("blank_text")
    rows = embedder(rows.observe(seen, F.count(F.lit(1)).alias("read"), *counts).where(~other & ~blank))
    rows = rows.observe(embedded, F.count_if(F.col("embedding").isNull()).alias("no_vector")).where(F.col("embedding").isNotNull())
    name = trim_ws(F.col(tenant_field)) if tenant is None else tenant
    points = prepare_points(rows, name, drop=("embedding", text_field), stamp_field=stamp_field)
    return _loaded(store.upsert(collection, points), seen, embedded)


def embed_documents(records: DataFrame, embedder: EmbedStep, tenant: str | None = None, tenant_field: str = "org_id",
                    text: str = "text", uid: str = "uid", window_size: int = 400, overlap: int = 80,
                    min_tokens: int = 100, counter: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """Text fallback, markdown cleaning, overlapping windows, then one vector for each window.

    Windows are measured in words, or in what ``counter`` counts, such as the tokens of a model.
    """
    if tenant is not None:
        records = prepare.filter_tenant(records, tenant, tenant_field)
    records = prepare.fill_text_from_doc(records, text)
    if counter is not None:
        return embedder(chunk.chunk_recursive(records, text, uid, window_size, overlap, min_tokens, counter))
    return embedder(chunk.chunk_markdown(records, text, uid, window_size, overlap, min_tokens))


def embed_csv(spark, path: str, output: str, embedder: EmbedStep, tenant: str | None = None,
              tenant_field: str = "org_id", keep_other_tenants: bool = False, multi_line: bool = True,
              **options) -> None:
    """Embed a CSV into another CSV, optionally carrying the rows of the other tenants along unchanged."""
    records = prepare.fill_text_from_doc(scan_csv(spark, path, multi_line=multi_line))
    out = embed_documents(records, embedder, tenant, tenant_field, **options)
    if keep_other_tenants and tenant is not None:
        out = replace_tenant_slice(records, out.withColumn("embedding", F.to_json("embedding")), tenant, tenant_field)
    writers.write_embedded_csv(out, output)


def query_texts(spark, texts: Sequence[str]) -> DataFrame:
    """The non-blank texts of a request, stripped and numbered from 0."""
    kept = [text.strip() for text in texts if text and text.strip()]
    return local_table(spark, list(enumerate(kept)), "query_index int, query_text string")


def search_collection(store: CollectionStore, collection: str, queries: DataFrame, limit: int = 10,
                      tenant: str | None = None, matches: dict[str, str] | None = None,
                      payload_keys: str | Sequence[str] | None = None, with_vectors: bool = False,
                      full_payload: bool = False, probes: int | None = None) -> DataFrame:
    """Ranked hits of ``(query_index, qvec[, query_text])`` with their payloads.

    Tenant and payload filters apply before ranking. With ``probes`` each query searches that many of the cells of the
    collection (:meth:`CollectionStore.set_cells`), and no file of another cell is opened. Payloads and vectors are read
    for the partitions of the hits only.
    """
    if tenant is not None:
        _require_tenant(store, collection, tenant)
    meta = store.describe(collection)
    # Several steps read the queries: their vectors are computed once, which matters with a slow model.
    queries = materialize(queries, "queries")
    search.check_queries(queries, meta.vector_size)
    matches = dict(matches or {})
    if tenant is not None and not meta.partitioned:
        matches["tenant_name"] = tenant
        tenant = None
    if probes is None:
        hits = search.knn_exact(prepare.match_filter(store.points(collection, tenant), matches), queries, limit)
    else:
        centroids = store.centroids(collection)
        if not centroids:
            raise ValueError(f"Collection {collection!r} has no cells to probe.")
        asked = search.assign_cells(queries, centroids, "qvec", probes)
        probed = [row["cell"] for row in asked.select("cell").distinct().collect()]  # at most one for each centroid
        placed = prepare.match_filter(store.points(collection, tenant, cells=probed), matches)
        hits = search.knn_exact(placed, asked, limit, group="cell")
    hits = materialize(hits, "hits")
    columns = ["payload"] + (["vector"] if with_vectors else [])
    out = search.attach_payload(hits, store.points_beside(collection, hits), columns, queries.count() * limit)
    if not full_payload:
        out = prepare.prune_payload_keys(out)
    out = prepare.project_payload(out, payload_keys)
    return label_results(out, queries) if "query_text" in queries.columns else out


def text_search(store: CollectionStore, collection: str, queries: DataFrame, embedder: EmbedStep, limit: int = 5,
                **options) -> DataFrame:
    """Search by text: ``queries`` has ``query_index, query_text``; ``embedder`` reads ``text``, adds ``embedding``."""
    texts = queries.withColumn("query_text", trim_ws(F.col("query_text"))).where(F.col("query_text") != "")
    embedded = embedder(texts.withColumn("text", F.col("query_text")))
    return search_collection(
        store, collection, embedded.select("query_index", "query_text", F.col("embedding").alias("qvec")), limit, **options
    )


def train_cells(store: CollectionStore, collection: str, cells: int, seed: int = 42) -> int:
    """Find centroids by k-means over all points and lay the collection out by them; returns how many there are."""
    centroids = search.train_centroids(store.points(collection), cells, seed)
    store.set_cells(collection, centroids)
    return len(centroids)


def export_collection(store: CollectionStore, collection: str, path: str, tenant: str | None = None) -> dict:
    meta = store.describe(collection)
    if tenant is not None:
        _require_tenant(store, collection, tenant)
    points = _tenant_points(store, collection, tenant)
    return writers.export_points(points, path, collection, meta.vector_size, meta.partitioned)


def _backup_target(spark, path: str, named: str | None) -> tuple[str, Row | None]:
    """Where a backup goes: the collection named by the caller wins over the one noted at export."""
    noted = read_manifest(spark, path)
    notes = None if noted is None else noted.first()
    if named or notes:
        return named or notes["collection"], notes
    raise ValueError(f"No manifest lies beside {path!r}, so the collection must be named.")


def import_collection(store: CollectionStore, path: str, collection: str | None = None, tenant: str | None = None,
                      dry_run: bool = False, tenant_field: str = "tenant_name") -> int:
    """Load a backup. Every line is checked first; one bad line and nothing is written."""
    spark = store.spark
    target, saved = _backup_target(spark, path, collection)
    meta = store.describe(target)
    if saved and saved["vector_size"] != meta.vector_size:
        raise ValueError(f"The backup has vectors of {saved['vector_size']}, {target!r} expects {meta.vector_size}.")

    def lines(numbered: bool) -> DataFrame:
        df = scan_backup(spark, path, line_numbers=numbered)
        return prepare.import_tenant_filter(df, tenant, tenant_field) if tenant is not None else df

    registry = None
    if meta.partitioned:
        registry = local_table(spark, [(t,) for t in store.tenants(target)], "tenant string")

    def report() -> None:
        bad = import_violations(lines(True), meta.vector_size, registry, tenant_field)
        found = bad.count()
        if found:
            first = bad.orderBy("line_no").limit(10).collect()
            more = f"; and {found - len(first)} more line(s)" if found > len(first) else ""
            raise ValueError("; ".join(f"Line {row['line_no']}: {row['reason']}" for row in first) + more)

    if dry_run:
        report()
        return lines(False).count()
    points = lines(False).select(
        prepare.import_tenant(field=tenant_field).alias("tenant"), F.col("id").alias("point_id"), "vector", "payload",
        "line_order",
    )
    try:
        return store.upsert(target, points, order=["line_order"])
    except RejectedLoad:
        # Only a backup that was refused is read again, to say which lines are wrong.
        report()
        raise


def restore_tenant(store: CollectionStore, path: str, tenant: str, collection: str | None = None,
                   dry_run: bool = False) -> int:
    """Register one tenant and import its points."""
    target, saved = _backup_target(store.spark, path, collection)
    if not dry_run:
        store.ensure(target, [tenant], saved["vector_size"] if saved else 1024)
    return import_collection(store, path, target, tenant, dry_run)


def persist_registry(store: CollectionStore, path: str) -> None:
    writers.save_registry(store.registry(), path)


def restore_registry(store: CollectionStore, path: str, force_recreate: bool = False,
                     **options) -> list[EnsureResult]:
    """Ensure every collection and tenant of a registry file."""
    rows = read_registry(store.spark, path).orderBy("collection").collect()
    return [store.ensure(r["collection"], r["tenants"], force_recreate=force_recreate, **options) for r in rows]
