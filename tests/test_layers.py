"""Layers of a collection, its cells, and what searches and loads read and write."""

import random

import pytest
from pyspark.sql import functions as F

from shardloom.operators import search
from shardloom.plans import collections, jobs
from shardloom.plans.collections import CollectionStore
from shardloom.session import scratch_path


@pytest.fixture
def store(spark):
    return CollectionStore(spark, scratch_path(spark, "store"))


def vectors(spark, data, size=2):
    """``(tenant, point_id, vector, seq)`` rows."""
    payload = F.to_variant_object(F.struct(F.col("seq").alias("n")))
    return spark.createDataFrame(data, "tenant string, point_id string, vector array<double>, seq bigint").withColumn("payload", payload)


def content(df):
    return {(r["tenant"], r["point_id"]): (tuple(r["vector"]), r["seq"]) for r in df.collect()}


def written(store, name, commits):
    return sum(p[3] for p in store.version(name).partitions if p[2] not in commits)


def test_an_upsert_writes_what_arrives(spark, store):
    store.ensure("c", ["A"], vector_size=2, buckets=4)
    base = spark.range(20_000).select(F.lit("A").alias("tenant"), F.col("id").cast("string").alias("point_id"),
                                      F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.col("id").alias("seq"))
    store.upsert("c", base)
    before = {p[2] for p in store.version("c").partitions}
    store.upsert("c", base.where("seq % 200 = 0").withColumn("vector", F.array(F.lit(9.0), F.lit(9.0))))
    assert written(store, "c", before) == 100
    assert store.points("c").count() == 20_000
    assert store.points("c").where(F.col("vector")[0] == 9).count() == 100
    assert store.compact("c") == 4 and store.compact("c") == 0
    assert store.points("c").count() == 20_000 and len(store.version("c").partitions) == 4
    assert store.points("c").where(F.col("vector")[0] == 9).count() == 100


@pytest.mark.parametrize("celled, broadcast", [(False, 1_000_000), (True, 1_000_000), (True, 0)])
def test_any_sequence_of_loads_equals_a_dictionary(spark, store, monkeypatch, celled, broadcast):
    monkeypatch.setattr(collections, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(collections, "LAYER_SHARE", 100)
    monkeypatch.setattr(collections, "MOST_LAYERS", 4)
    rnd = random.Random(celled + broadcast)
    store.ensure("c", ["A", "B"], vector_size=2, buckets=2)
    want, labels, seq, most = {}, {}, 0, 0
    for step in range(7):
        rows = []
        for _ in range(rnd.choice([1, 2, 30])):
            seq += 1
            rows.append((rnd.choice("AB"), str(rnd.randrange(40)), [rnd.uniform(-1, 1), rnd.choice([0.0, 1.0])], seq))
        newer_only = step % 3 == 2
        if newer_only:
            rows = [(t, p, v, s - rnd.randrange(60)) for t, p, v, s in rows]
        store.upsert("c", vectors(spark, rows), newer_only=newer_only)
        last = {}
        for i, (t, p, v, s) in enumerate(rows):
            if (t, p) not in last or s > last[t, p][1]:
                last[t, p] = tuple(v), s
        for key, (v, s) in last.items():
            if not newer_only or key not in want or want[key][1] <= s:
                want[key] = v, s
        if step == 1:
            labels["s"] = dict(want)
            store.create_snapshot("c", "s")
        if step == 3 and celled:
            store.set_cells("c", [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]])
        most = max(most, max(map(len, store.version("c").layers().values())))
        got = content(store.points("c"))
        assert {k: s for k, (_, s) in got.items()} == {k: s for k, (_, s) in want.items()}
        assert all(abs(a - b) < 1e-6 for k, (v, _) in got.items() for a, b in zip(v, want[k][0]))
        assert {k[1] for k in want if k[0] == "A"} == {r["point_id"] for r in store.points("c", "A").collect()}
    assert 2 <= most <= 4
    assert [r["points"] for r in store.list_snapshots("c").collect()] == [len(labels["s"])]
    store.restore_snapshot("c", "s")
    restored = {k: s for k, (_, s) in content(store.points("c")).items()}
    assert restored == {k: labels["s"].get(k, v)[1] for k, v in want.items()}
    store.vacuum("c")
    assert {k: s for k, (_, s) in content(store.points("c")).items()} == restored


def test_many_layers_are_folded(spark, store):
    store.ensure("c", ["A"], vector_size=2, buckets=1)
    store.upsert("c", vectors(spark, [("A", str(i), [1.0, 0.0], i) for i in range(200)]))
    depth = []
    for i in range(collections.MOST_LAYERS + 2):
        store.upsert("c", vectors(spark, [("A", str(i), [2.0, 0.0], 1000 + i)]))
        depth.append(len(store.version("c").partitions))
    assert max(depth) == collections.MOST_LAYERS and depth[-1] < collections.MOST_LAYERS
    store.upsert("c", vectors(spark, [("A", str(i), [3.0, 0.0], 5000 + i) for i in range(100)]))  # half of the points
    assert len(store.version("c").partitions) == 1
    assert store.points("c").where(F.col("vector")[0] == 3).count() == 100 and store.points("c").count() == 200


def _opened(df):
    return {r[0] for r in df.select(F.col("_metadata.file_path")).distinct().collect()}


def test_only_probed_cells_are_opened(spark, store):
    rnd = random.Random(4)
    store.ensure("c", ["A", "B"], vector_size=2, buckets=2)
    data = [(rnd.choice("AB"), str(i), [rnd.gauss(0, 1), rnd.gauss(0, 1)], i) for i in range(300)] + [("A", "zero", [0.0, 0.0], 300)]
    store.upsert("c", vectors(spark, data))
    queries = spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.9, -0.2])], "query_index int, qvec array<double>")
    with pytest.raises(ValueError, match="no cells"):
        jobs.search_collection(store, "c", queries, probes=1)
    with pytest.raises(ValueError, match="vectors of 2"):
        store.set_cells("c", [[1.0]])
    centroids = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]]
    store.set_cells("c", centroids)
    assert store.points("c").count() == 301
    files = _opened(store.points("c", cells=[0, 3]))
    assert files and all("/cell=0/" in f or "/cell=3/" in f for f in files)
    assert "cell" in store.points("c", cells=[0])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    # Points that move keep one place, and a row of a cell that is not probed still replaces one of a probed cell.
    moved = [(t, p, [-v[0], -v[1]], 1000 + s) for t, p, v, s in data[:20]]
    store.upsert("c", vectors(spark, moved))
    for probes in (1, 2, 4):
        got = jobs.search_collection(store, "c", queries, 8, probes=probes).collect()
        placed = search.knn_ivf(store.points("c"), queries, centroids, 8, probes).collect()
        key = lambda r: (r["query_index"], r["rank"], r["tenant"], r["point_id"], r["score"])
        assert sorted(map(key, got)) == sorted(map(key, placed))
    exact = jobs.search_collection(store, "c", queries, 8).collect()
    assert sorted((r["query_index"], r["point_id"]) for r in exact) == sorted((r["query_index"], r["point_id"]) for r in got)
    one = jobs.search_collection(store, "c", queries, 3, tenant="B", probes=2).collect()
    assert len(one) == 6 and {r["tenant"] for r in one} == {"B"}


def test_cells_found_by_k_means(spark, store):
    rnd = random.Random(6)
    store.ensure("c", ["A"], vector_size=2)
    centers = [(1, 0), (0, 1), (-1, 0)]
    data = [("A", str(i), [centers[i % 3][0] + rnd.gauss(0, 0.05), centers[i % 3][1] + rnd.gauss(0, 0.05)], i) for i in range(90)]
    store.upsert("c", vectors(spark, data))
    assert jobs.train_cells(store, "c", 3) == 3
    cells = {r["cell"]: r["n"] for r in store.points("c", cells=[0, 1, 2]).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert cells == {0: 30, 1: 30, 2: 30}


def test_payloads_are_read_where_the_hits_lie(spark, store):
    store.ensure("c", ["A", "B", "C"], vector_size=2, buckets=8)
    data = [("ABC"[i % 3], str(i), [1.0, i / 100], i) for i in range(300)]
    store.upsert("c", vectors(spark, data))
    hits = spark.createDataFrame([(0, "4", "B"), (0, "7", "B")], "query_index int, point_id string, tenant string")
    beside = store.points_beside("c", hits)
    files = _opened(beside)
    assert 1 <= len(files) <= 2 and all("tenant=B/" in f for f in files)
    assert search.attach_payload(hits, beside, ["payload"], 2).count() == 2
    assert store.points_beside("c", hits.limit(0)).count() == 0


def test_a_flat_collection_finds_its_tenants(spark, store):
    store.ensure("flat", vector_size=2)
    data = vectors(spark, [("acme", "1", [1.0, 0.0], 1), ("acme", "2", [0.9, 0.1], 2), ("other", "3", [1.0, 0.0], 3)])
    store.upsert("flat", data.where("seq < 3").unionByName(data.where("seq = 3").withColumn("payload", F.lit(None).cast("variant"))))
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_index int, qvec array<double>")
    hits = jobs.search_collection(store, "flat", queries, 5, tenant="acme", full_payload=True).collect()
    assert [r["point_id"] for r in sorted(hits, key=lambda r: r["rank"])] == ["1", "2"]
    names = {r["point_id"]: r["t"] for r in store.points("flat").select("point_id", F.try_variant_get("payload", "$.tenant_name", "string").alias("t")).collect()}
    assert names == {"1": "acme", "2": "acme", "3": "other"}
    kept = store.points("flat").select("tenant", "point_id", "vector", "payload", "seq")
    store.upsert("flat", kept.where("point_id = '1'"))  # what comes back keeps its name
    assert store.points("flat").where(F.try_variant_get("payload", "$.tenant_name", "string") == "acme").count() == 2
