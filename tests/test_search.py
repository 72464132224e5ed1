import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import search
from shardloom.session import scratch_path


def brute_force(points, queries, k, allowed=lambda q, p: True):
    out = {}
    for q in queries:
        scored = []
        for p in points:
            v, w = np.array(p[2]), np.array(q[1])
            if allowed(q, p) and np.linalg.norm(v) > 0:
                scored.append((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), p[1], p[0]))
        out[q[0]] = [(tenant, pid) for _, pid, tenant in sorted(scored)[:k]]
    return out


def found(hits):
    out = {}
    for row in hits.orderBy("query_index", "rank").collect():
        out.setdefault(row["query_index"], []).append((row["tenant"], row["point_id"]))
    return out


@pytest.fixture(scope="module")
def data():
    """Random points of which a third are copies of one vector and a third belong to one tenant."""
    rng = np.random.default_rng(7)
    copy = rng.normal(size=8)
    points = []
    for i in range(600):
        vector = copy * (1 + i % 5) if i % 3 == 0 else rng.normal(size=8)
        points.append(("hot" if i % 3 == 1 else f"t{i % 4}", str(i), [float(x) for x in vector]))
    points.append(("t0", "zero", [0.0] * 8))
    queries = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(12)] + [(12, [float(x) for x in copy])]
    return points, queries


@pytest.fixture(scope="module")
def frames(spark, data):
    points = spark.createDataFrame(data[0], "tenant string, point_id string, vector array<double>").repartition(5)
    return points, spark.createDataFrame(data[1], "query_index int, qvec array<double>")


def test_exact_equals_brute_force_with_many_equal_scores(frames, data):
    assert found(search.knn_exact(*frames, 10)) == brute_force(*data, 10)


def test_large_query_sets_take_the_blocked_plan(frames, data):
    assert found(search.knn_exact(*frames, 10, broadcast_bytes=1, most_passes=3)) == brute_force(*data, 10)


def test_several_passes_share_the_queries(frames, data):
    hits = search.knn_exact(*frames, 10, broadcast_bytes=8 * 8 * 4)
    assert hits._jdf.queryExecution().executedPlan().toString().count("MapInArrow") > 1
    assert found(hits) == brute_force(*data, 10)


def test_blocks_of_any_size_give_the_same_hits(frames, data):
    for block_bytes in (8 * 8 * 5, 8 * 8 * 100, 1 << 20):
        assert found(search.knn_blocked(*frames, 7, block_bytes=block_bytes)) == brute_force(*data, 7)


def test_blocks_move_each_point_once(frames):
    plan = search.knn_blocked(*frames, 7, block_bytes=8 * 8 * 20)._jdf.queryExecution().executedPlan().toString()
    copied = [line for line in plan.splitlines() if "Generate explode" in line]
    assert "FlatMapCoGroups" not in plan and "Join" not in plan
    assert len(copied) == 1 and "qvec" in copied[0] and "point_id" not in copied[0], plan


def test_each_query_searches_its_own_tenant(frames, data):
    points, queries = frames
    own = queries.withColumn("tenant", F.when(F.col("query_index") % 2 == 0, "hot").otherwise("t2"))
    expected = brute_force(*data, 5, lambda q, p: p[0] == ("hot" if q[0] % 2 == 0 else "t2"))
    for block_bytes in (8 * 8 * 20, 1 << 20):
        assert found(search.knn_blocked(points, own, 5, group="tenant", block_bytes=block_bytes)) == expected
    assert found(search.knn_tenant(points, own, 5)) == expected
    assert found(search.knn_tenant(points, queries, 5, tenant="hot")) == brute_force(*data, 5, lambda q, p: p[0] == "hot")


def test_ivf_with_every_cell_is_exact_and_with_fewer_is_a_part(frames, data):
    points, queries = frames
    centroids = search.train_centroids(points, 6)
    exact = brute_force(*data, 10)
    assert found(search.knn_ivf(points, queries, centroids, 10, probes=6)) == exact
    stored = search.build_ivf(points, centroids, scratch_path(points.sparkSession, "ivf"))
    one = queries.where("query_index = 3")
    plan = search.knn_ivf(stored, one, centroids, 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*cell#\d+ IN \(\d+,\d+\)", plan), plan
    some = search.knn_ivf(stored, queries, centroids, 10, probes=2)
    assert {len(h) for h in found(some).values()} == {10}
    scores = some.join(search.knn_exact(points, queries, 600).withColumnRenamed("score", "exact"),
                       ["query_index", "tenant", "point_id"])
    assert scores.where(F.col("score") != F.col("exact")).count() == 0 and scores.count() == some.count()


def test_more_hits_than_points(frames, data):
    points, queries = frames
    few = points.where("tenant = 't1'").limit(3)
    assert search.knn_exact(few, queries, 10).groupBy("query_index").count().where("count != 3").count() == 0


def test_no_queries_no_points(frames):
    points, queries = frames
    assert search.knn_exact(points, queries.limit(0)).count() == 0
    assert search.knn_blocked(points, queries.limit(0)).count() == 0
    assert search.knn_exact(points.limit(0), queries).count() == 0
    assert search.knn_blocked(points.limit(0), queries).count() == 0


def test_query_sizes_are_checked(frames, spark):
    search.check_queries(frames[1], 8)
    with pytest.raises(ValueError):
        search.check_queries(frames[1], 7)
    with pytest.raises(ValueError):
        search.check_queries(spark.createDataFrame([(0, None)], "query_index int, qvec array<double>"), 8)


def test_scroll_visits_every_point_once(frames):
    points, _ = frames
    points = points.select("point_id", "tenant").cache()
    seen, after = [], None
    while page := search.scroll_page(points, 100, after).collect():
        seen += [tuple(row) for row in page]
        after = seen[-1]
    assert seen == sorted(tuple(row) for row in points.collect())


def test_scroll_keeps_an_id_of_several_tenants(spark):
    points = spark.createDataFrame([("A", "1"), ("B", "1"), ("A", "2")], "tenant string, point_id string")
    seen, after = [], None
    while page := search.scroll_page(points, 1, after).collect():
        seen.append((page[0]["point_id"], page[0]["tenant"]))
        after = seen[-1]
    assert seen == [("1", "A"), ("1", "B"), ("2", "A")]


def test_vectors_that_are_not_finite_harm_no_other(spark):
    rows = [("T", str(i), [1.0, float(i)]) for i in range(20)]
    rows += [("T", "bad", [float("inf"), 1.0]), ("T", "nan", [float("nan"), 1.0]), ("T", "null", [None, 1.0])]
    points = spark.createDataFrame(rows, "tenant string, point_id string, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_index int, qvec array<double>")
    for plan in (search.knn_exact, search.knn_blocked):
        assert [r["point_id"] for r in plan(points, queries, 5).orderBy("rank").collect()] == ["0", "1", "2", "3", "4"]


def test_queries_of_different_sizes_are_refused(spark):
    points = spark.createDataFrame([("T", "1", [1.0, 0.0])], "tenant string, point_id string, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0])], "query_index int, qvec array<double>")
    for plan in (search.knn_exact, search.knn_blocked):
        with pytest.raises(ValueError, match="different sizes"):
            plan(points, queries, 5)


def test_cells_do_not_depend_on_shares(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centroids = rng.normal(size=(60, 4)).tolist()
    points = spark.createDataFrame([("T", str(i), v.tolist()) for i, v in enumerate(rng.normal(size=(50, 4)))],
                                   "tenant string, point_id string, vector array<double>")
    def cells():
        return sorted((r["point_id"], r["cell"]) for r in search.assign_cells(points, centroids, probes=3).collect())
    whole = cells()
    monkeypatch.setattr(search, "SCORE_CELLS", 70_000)
    assert cells() == whole and len(whole) == 150


def test_payload_joins_hits_only(frames):
    points, queries = frames
    hits = search.knn_exact(points, queries, 3)
    full = search.attach_payload(hits, points, ["vector"], most_hits=39)
    assert full.count() == hits.count() == 39


def test_a_first_scan_gives_floors(spark, monkeypatch):
    rnd = random.Random(9)
    data = [("T", str(i), [round(rnd.gauss(0, 1), 1) for _ in range(4)]) for i in range(4000)]
    points = spark.createDataFrame(data, "tenant string, point_id string, vector array<double>").repartition(40)
    queries = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(6)] + [(6, [0.0] * 4)], "query_index int, qvec array<double>")
    plain = sorted(map(tuple, search.knn_exact(points, queries, 5).collect()))
    monkeypatch.setattr(search, "FLOOR_TASKS", 2)
    assert sorted(map(tuple, search.knn_exact(points, queries, 5).collect())) == plain and len(plain) == 30
    assert sorted(map(tuple, search.knn_exact(points.where("point_id < '1002'"), queries, 500).collect())) == sorted(
        map(tuple, search.knn_blocked(points.where("point_id < '1002'"), queries, 500).collect()))
    rows = [r for r in queries.where("query_index < 6").withColumn("grp", F.lit(0)).collect()]
    scanned = points.withColumn("grp", F.lit(0))
    floors = search._floors(scanned, rows, 4, 5, 40)
    left = search._scan(scanned, rows, 4, 5, floors).count()
    assert search._scan(scanned, rows, 4, 5).count() == 6 * 5 * 40 and left < 6 * 5 * 40 / 4


def test_pages_equal_scrolling(spark):
    data = [(t, str(i % 60)) for i, t in enumerate("ABCD" * 60)]
    points = spark.createDataFrame(sorted(set(data)), "tenant string, point_id string").repartition(7)
    want, after, page = {}, None, 0
    while rows := search.scroll_page(points, 17, after).collect():
        want.update({(r["tenant"], r["point_id"]): page for r in rows})
        after, page = (rows[-1]["point_id"], rows[-1]["tenant"]), page + 1
    got = {(r["tenant"], r["point_id"]): r["page"] for r in search.number_pages(points, 17).collect()}
    assert got == want and max(got.values()) == 3
    assert search.number_pages(points.limit(0), 17).count() == 0
