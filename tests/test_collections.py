import gzip
import json

import pytest
from pyspark.sql import functions as F

from shardloom.operators import embed
from shardloom.plans import jobs
from shardloom.plans.collections import CollectionStore
from shardloom.session import scratch_path
from shardloom.sinks import writers
from shardloom.sources import csv as csv_source
from shardloom.sources import files
from shardloom.sources.backup import manifest_path, read_manifest
from shardloom.sources.csv import row_ordinal, scan_csv
from shardloom.sources.registry import read_registry
from shardloom.sources.vectors import scan_query_vectors
from shardloom.streaming.jobs import stream_upsert


@pytest.fixture
def store(spark):
    return CollectionStore(spark, scratch_path(spark, "store"))


def points(spark, data):
    """``(tenant, point_id, value, seq)`` rows as points of one dimension."""
    df = spark.createDataFrame(data, "tenant string, point_id string, v double, seq bigint")
    payload = F.to_variant_object(F.struct("v", F.concat(F.lit("f"), "point_id").alias("filename")))
    return df.select("tenant", "point_id", F.array("v").alias("vector"), payload.alias("payload"), "seq")


def content(df):
    return sorted((r["tenant"], r["point_id"], r["v"]) for r in df.select("tenant", "point_id", F.col("vector")[0].alias("v")).collect())


def test_upsert_replaces_whole_points_and_the_last_row_wins(spark, store):
    store.ensure("c", ["A", "B"], vector_size=1)
    assert store.upsert("c", points(spark, [("A", "1", 1.0, 0), ("A", "2", 2.0, 1), ("B", "1", 3.0, 2)])) == 3
    update = points(spark, [("A", "2", 21.0, 0), ("A", "2", 22.0, 1), ("A", "3", 4.0, 2)])
    assert store.upsert("c", update) == 3
    expected = [("A", "1", 1.0), ("A", "2", 22.0), ("A", "3", 4.0), ("B", "1", 3.0)]
    assert content(store.points("c")) == expected
    store.upsert("c", update)
    assert content(store.points("c")) == expected
    assert content(store.points("c", "B")) == [("B", "1", 3.0)]
    assert content(store.points("c", version=2)) == []
    assert len(content(store.points("c", version=3))) == 3


def test_bad_loads_change_nothing(spark, store):
    store.ensure("c", ["A"], vector_size=1)
    before = store.version_numbers("c")
    with pytest.raises(ValueError, match="not registered"):
        store.upsert("c", points(spark, [("A", "1", 1.0, 0), ("Z", "1", 1.0, 0)]))
    with pytest.raises(ValueError, match="vector size"):
        store.upsert("c", points(spark, [("A", "1", 1.0, 0)]).withColumn("vector", F.array(F.lit(1.0), F.lit(2.0))))
    with pytest.raises(ValueError, match="does not exist"):
        store.upsert("nope", points(spark, []))
    assert store.version_numbers("c") == before and store.points("c").count() == 0
    assert store.upsert("c", points(spark, [])) == 0


def test_tenant_names_survive_as_folder_names(spark, store):
    names = ["007", "a/b=c", "x y%", "1.50", "true", "2024-01-01"]
    store.ensure("c", names, vector_size=1, buckets=2)
    store.upsert("c", points(spark, [(name, "1", 1.0, 0) for name in names]))
    assert [r[0] for r in content(store.points("c"))] == sorted(names)
    for name in names:
        assert content(store.points("c", name)) == [(name, "1", 1.0)]


def test_without_tenants_the_id_alone_is_the_key(spark, store):
    store.ensure("c", vector_size=1)
    store.upsert("c", points(spark, [("A", "1", 1.0, 0), ("B", "1", 2.0, 1)]))
    assert content(store.points("c")) == [("__default__", "1", 2.0)]
    with pytest.raises(RuntimeError):
        store.ensure("c", ["A"])
    assert store.ensure("c", ["A"], vector_size=1, force_recreate=True).collection_created
    assert store.points("c").count() == 0


def test_ensure_is_idempotent(store):
    first = store.ensure("c", ["b", "a", "", "b"], vector_size=3)
    assert (first.collection_created, first.created, first.skipped) == (True, ["b", "a"], [])
    again = store.ensure("c", ["a", "d"])
    assert (again.collection_created, again.created, again.skipped) == (False, ["d"], ["a"])
    assert store.describe("c").vector_size == 3
    assert store.names() == ["c"] and store.tenants("c") == ["a", "b", "d"]


def test_delete_tenants_and_collections(spark, store):
    store.ensure("c", ["A", "B"], vector_size=1)
    store.upsert("c", points(spark, [("A", "1", 1.0, 0), ("B", "1", 2.0, 1)]))
    assert store.delete_tenants("c", ["A", "Z"]) == (["A"], ["Z"])
    assert content(store.points("c")) == [("B", "1", 2.0)] and store.tenants("c") == ["B"]
    assert store.delete_collection("c") is True and store.delete_collection("c") is False
    assert store.names() == []


def test_promoted_keys_push_down(spark, store):
    store.ensure("c", ["A"], vector_size=1, promoted=["filename"])
    store.upsert("c", points(spark, [("A", str(i), 1.0, i) for i in range(20)]))
    found = jobs.search_collection(
        store, "c", spark.createDataFrame([(0, [1.0])], "query_index int, qvec array<double>"), 5, "A", {"filename": "f7"})
    assert [r["point_id"] for r in found.collect()] == ["7"]
    plan = store.points("c", "A").where("filename = 'f7'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(filename), EqualTo(filename,f7)]" in plan


def test_snapshots_keep_their_version_through_vacuum(spark, store):
    store.ensure("c", ["A"], vector_size=1, buckets=1)
    store.upsert("c", points(spark, [("A", "1", 1.0, 0), ("A", "2", 2.0, 0)]))
    store.create_snapshot("c", "s")
    store.upsert("c", points(spark, [("A", "2", 22.0, 0)]))
    store.upsert("c", points(spark, [("A", "3", 3.0, 0)]))
    assert len(store.vacuum("c")) == 1
    listed = store.list_snapshots("c").first()
    assert (listed["snapshot"], listed["points"], listed["tenants"]) == ("s", 2, 1) and listed["bytes"] > 0
    store.restore_snapshot("c", "s", priority="replica")
    assert content(store.points("c")) == [("A", "1", 1.0), ("A", "2", 22.0), ("A", "3", 3.0)]
    store.restore_snapshot("c", "s", priority="snapshot")
    assert content(store.points("c")) == [("A", "1", 1.0), ("A", "2", 2.0), ("A", "3", 3.0)]


def test_export_then_import_is_the_same_table(spark, store):
    store.ensure("c", ["A", "B"], vector_size=1)
    uuid = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    store.upsert("c", points(spark, [("A", "1", 1.0, 0), ("A", uuid, 2.0, 1), ("B", "18446744073709551615", 3.0, 2)]))
    path = scratch_path(spark, "out") + "/points"
    manifest = jobs.export_collection(store, "c", path)
    assert manifest["points_total"] == 3 and manifest["points_per_shard"] == {"A": 2, "B": 1}
    lines = [json.loads(r[0]) for r in spark.read.text(path).select("value").collect()]
    assert {type(line["id"]) for line in lines} == {int, str}
    store.ensure("d", ["A", "B"], vector_size=1)
    assert jobs.import_collection(store, path, "d", dry_run=True) == 3 and store.points("d").count() == 0
    assert jobs.import_collection(store, path, "d") == 3
    assert content(store.points("d")) == content(store.points("c"))
    payloads = [
        {r["point_id"]: json.loads(r["p"]) for r in store.points(name).select("point_id", F.to_json("payload").alias("p")).collect()}
        for name in ("c", "d")
    ]
    assert payloads[0] == payloads[1]
    store.delete_tenants("d", ["A"])
    assert jobs.restore_tenant(store, path, "A", "d") == 2
    assert content(store.points("d")) == content(store.points("c"))


def test_import_reports_every_kind_of_bad_line(spark, store):
    path = scratch_path(spark, "in") + "/b.jsonl"
    good = '{"id": 1, "payload": {"tenant_name": "A"}, "vector": [1]}'
    bad = [
        "not json", '{"id": 2, "payload": {}, "vector": [1]}', '{"id": 3, "vector": [1], "shard_key": "Z"}',
        '{"id": 4, "vector": [1, 2], "shard_key": "A"}', '{"id": 5, "payload": {}, "shard_key": "A"}',
    ]
    files.write_text(spark, path, "\n".join([good, "", *bad]))
    store.ensure("c", ["A"], vector_size=1)
    with pytest.raises(ValueError) as error:
        jobs.import_collection(store, path, "c")
    assert str(error.value).split("; ") == [
        "Line 3: malformed line", "Line 4: shard key missing", "Line 5: shard key not registered",
        "Line 6: dimension 2 != expected 1", "Line 7: missing vector"]
    assert store.points("c").count() == 0
    with pytest.raises(ValueError, match="must be named"):
        jobs.import_collection(store, path)


def test_the_last_line_of_a_backup_wins(spark, store):
    path = scratch_path(spark, "in") + "/b.jsonl"
    lines = [json.dumps({"id": i % 50, "vector": [float(i)], "shard_key": "A"}) for i in range(500)]
    files.write_text(spark, path, "\n".join(lines))
    store.ensure("c", ["A"], vector_size=1)
    assert jobs.import_collection(store, path, "c") == 500
    assert sorted(r[2] for r in content(store.points("c"))) == [float(i) for i in range(450, 500)]


def test_manifest_names():
    assert manifest_path("/x/points.jsonl") == "/x/points.meta.json"
    assert manifest_path("/x/points") == "/x/points.meta.json"


def test_old_manifests_may_lack_the_tenant_fields(spark):
    path = scratch_path(spark, "m") + "/b.jsonl"
    assert read_manifest(spark, path) is None
    files.write_text(spark, manifest_path(path), json.dumps({
        "version": 1, "collection": "c", "vector_size": 2, "uses_custom_sharding": False,
        "tenant_payload_field": "tenant_name", "points_total": 0}, indent=2))
    row = read_manifest(spark, path).first()
    assert row["vector_size"] == 2 and row["shard_keys_exported"] == [] and row["points_per_shard"] == {}


CSV = (
    '﻿uid,org_id,text,embedding,doc,filename,,Unnamed: 7\n'
    '007,A,"two\nlines","[1.0, 0.0]","{""k"": [1, 2]}",f1,j,j\n'
    ',A,no uid,"(0, 1)",,f2,j,j\n'
    'abc, A ,spaced tenant,"[1, 1]",,f3,j,j\n'
    'x,B,other,"[1, 1]",,f4,j,j\n'
    'bad,A,,oops,,f5,j,j\n'
)


@pytest.fixture
def csv_path(spark):
    path = scratch_path(spark, "csv") + "/q.csv"
    files.write_text(spark, path, CSV)
    return path


def test_csv_scan(spark, csv_path):
    df = row_ordinal(scan_csv(spark, csv_path, ["org_id"]))
    assert df.columns[:7] == ["uid", "org_id", "text", "embedding", "doc", "filename", "_c6"]
    first = df.where("row_pos = 0").first()
    assert first["uid"] == "007" and first["text"] == "two\nlines" and first["doc"] == '{"k": [1, 2]}'
    assert sorted(r["row_pos"] for r in df.collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="missing"):
        scan_csv(spark, csv_path, ["tenant"])


def test_ingest_csv(spark, store, csv_path):
    store.ensure("c", ["A"], vector_size=2)
    assert jobs.ingest_csv(store, "c", "A", csv_path) == 2
    found = {r["point_id"]: (r["vector"], json.loads(r["p"])) for r in store.points("c").withColumn("p", F.to_json("payload")).collect()}
    assert set(found) == {"7", "1"}
    assert found["7"] == ([1.0, 0.0], {
        "doc": {"k": [1, 2]}, "filename": "f1", "org_id": "A", "text": "two\nlines", "uid": "007"})
    with pytest.raises(ValueError, match="not registered"):
        jobs.ingest_csv(store, "c", "B", csv_path)


def test_embed_upsert_and_text_search(spark, store, csv_path):
    store.ensure("c", ["A"], vector_size=16)
    step = lambda df: embed.embed_by_hash(df, 16)
    assert jobs.embed_upsert_csv(store, "c", "A", csv_path, step) == 3
    queries = jobs.query_texts(spark, ["  spaced tenant ", "", "no uid"])
    hits = jobs.text_search(store, "c", queries, step, 1, tenant="A", payload_keys="filename", with_vectors=True)
    best = {r["query_text"]: (r["point_id"], json.loads(r["p"])) for r in hits.withColumn("p", F.to_json("payload")).collect()}
    assert best["no uid"] == ("1", {"filename": "f2"}) and best["spaced tenant"][1] == {"filename": "f3"}
    nested = writers.result_json(writers.nest_results(hits, "payload")).orderBy("query_index").collect()
    assert json.loads(nested[0]["value"])["points"][0]["payload"] == {"filename": "f3"}


def test_tenant_search_without_tenant_partitions(spark, store, csv_path):
    store.ensure("c", vector_size=16)
    step = lambda df: embed.embed_by_hash(df, 16)
    jobs.embed_upsert_csv(store, "c", "A", csv_path, step)
    jobs.embed_upsert_csv(store, "c", "B", csv_path, step)
    queries = jobs.query_texts(spark, ["other"])
    assert jobs.text_search(store, "c", queries, step, 9).count() == 4
    assert jobs.text_search(store, "c", queries, step, 9, tenant="B").count() == 1


def test_embed_csv_keeps_other_tenants_as_they_were(spark, csv_path):
    out = scratch_path(spark, "embedded")
    step = lambda df: embed.embed_by_hash(df, 4)
    jobs.embed_csv(spark, csv_path, out, step, tenant="A", keep_other_tenants=True, window_size=2, overlap=0, min_tokens=1)
    found = {r["uid"]: r for r in scan_csv(spark, out).collect()}
    assert found["x"]["embedding"] == "[1, 1]" and found["x"]["chunk_index"] is None
    assert len(json.loads(found["007"]["embedding"])) == 4 and found["007"]["chunk_count"] == "1"


@pytest.mark.parametrize("text", [
    "[[1, 2], [3, 4]]", '{"vectors": [[1, 2], {"vector": [3, 4]}]}', "[1, 2]\n\n[3, 4]\n",
    '{"vector": [1, 2]}\n{"vector": [3, 4]}', "[\n  [1,\n 2],\n  [3, 4]\n]",
])
def test_query_vector_layouts(spark, text):
    path = scratch_path(spark, "queries") + "/q.json"
    files.write_text(spark, path, text)
    found = scan_query_vectors(spark, path).orderBy("query_index").collect()
    assert [tuple(r) for r in found] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_ndjson_queries_are_numbered_over_all_lines(spark):
    path = scratch_path(spark, "queries") + "/q.json"
    files.write_text(spark, path, "\n\n".join(f"[{i}]" for i in range(100)))
    found = scan_query_vectors(spark, path, "ndjson").collect()
    assert {r["query_index"]: r["qvec"] for r in found} == {i: [float(i)] for i in range(100)}


def test_ordinals_do_not_depend_on_how_the_splits_are_numbered(spark):
    folder = scratch_path(spark, "ordinals")
    for name, lines in (("b", range(40, 200)), ("a", range(0, 40)), ("c", range(200, 203))):
        files.write_text(spark, f"{folder}/{name}.txt", "\n".join(map(str, lines)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        df = spark.read.text(folder)
        assert df.rdd.getNumPartitions() > 5
        for local_rows in (1000, 2):
            found = row_ordinal(df, local_rows=local_rows).collect()
            assert len(found) == 203 and all(int(r["value"]) == r["row_pos"] for r in found)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_registry_round_trip(spark, store):
    store.ensure("c", ["b", "a"], vector_size=1)
    store.ensure("d", ["z"], vector_size=1)
    path = scratch_path(spark, "registry")
    jobs.persist_registry(store, path)
    assert json.loads(spark.read.text(path, wholetext=True).first()[0]) == {"c": ["a", "b"], "d": ["z"]}
    assert read_registry(spark, path).count() == 2
    other = CollectionStore(spark, scratch_path(spark, "store"))
    jobs.restore_registry(other, path, vector_size=1)
    assert sorted(other.registry().collect()) == sorted(store.registry().collect())


def test_streamed_files_in_any_order_equal_one_batch(spark, store):
    data = [("A", str(i % 7), float(i), i) for i in range(60)]
    schema = "tenant string, point_id string, v double, seq bigint"
    arrivals = scratch_path(spark, "arrivals")
    for start in (40, 0, 20):
        spark.createDataFrame(data[start:start + 20], schema).coalesce(1).write.mode("append").parquet(arrivals)
    store.ensure("c", ["A"], vector_size=1, buckets=2)
    checkpoint = scratch_path(spark, "checkpoint")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
        as_points = stream.select("tenant", "point_id", F.array("v").alias("vector"), "seq")
        stream_upsert(as_points, store, "c", "s", checkpoint).awaitTermination()

    run()
    expected = sorted(("A", str(k), float(max(i for i in range(60) if i % 7 == k))) for k in range(7))
    assert content(store.points("c")) == expected
    versions = store.version_numbers("c")
    run()
    assert store.version_numbers("c") == versions
    replay = points(spark, [("A", "0", -1.0, 999)])
    assert store.upsert("c", replay, newer_only=True, stream=("s", 0)) == 0
    assert content(store.points("c")) == expected


def test_a_half_written_version_is_not_read(spark, store):
    store.ensure("c", ["A"], vector_size=1)
    store.upsert("c", points(spark, [("A", "1", 1.0, 0)]))
    files.write_text(spark, f"{store.root}/c/_versions/.99.json-draft", '{"num')
    assert content(store.points("c")) == [("A", "1", 1.0)]
    taken = f"{store.root}/c/_versions/{store.version('c').number + 1}.json"
    files.write_text(spark, taken, "{}")
    with pytest.raises(FileExistsError):
        files.publish_text(spark, taken, "{}")
    assert not [n for n in files.list_names(spark, f"{store.root}/c/_versions") if n.startswith(".") and n != ".99.json-draft"]


def test_vectors_that_are_not_finite_are_refused(spark, store):
    store.ensure("c", ["A"], vector_size=1)
    for value in (float("nan"), float("inf"), 1e39):
        with pytest.raises(ValueError, match="not finite"):
            store.upsert("c", points(spark, [("A", "1", value, 0)]))


def test_a_plain_load_without_tenant_partitions_keeps_its_tenant(spark, store, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('uid,org_id,embedding,text\n1,acme,"[1.0]",a\n2,acme,"[2.0]",b\n3,other,"[3.0]",c\n')
    store.ensure("flat", [], vector_size=1)
    assert jobs.ingest_csv(store, "flat", "acme", str(path)) == 2
    assert jobs.ingest_csv(store, "flat", "other", str(path)) == 1
    queries = spark.createDataFrame([(0, [1.0])], "query_index int, qvec array<double>")
    hits = jobs.search_collection(store, "flat", queries, 5, tenant="acme").collect()
    assert {r["point_id"] for r in hits} == {"1", "2"}


def test_malformed_lines_stop_an_import_of_one_tenant(spark, store):
    store.ensure("c", ["acme"], vector_size=1)
    path = f"{scratch_path(spark, 'torn')}/points"
    good = json.dumps({"id": 1, "vector": [1.0], "payload": {}, "shard_key": "acme"})
    files.write_text(spark, f"{path}/part-0.jsonl", good + "\n{not json\n")
    for tenant in (None, "acme"):
        with pytest.raises(ValueError, match="Line 2: malformed line"):
            jobs.import_collection(store, path, "c", tenant)
    assert store.points("c").count() == 0


@pytest.mark.parametrize("multi_line", [True, False])
def test_files_with_other_headers_are_united_by_name(spark, tmp_path, multi_line):
    (tmp_path / "a [1].csv").write_text('Unnamed: 0,uid,org_id,text\n0,1,A,hello\n1,2,A,"a, b"\n')
    (tmp_path / "b.csv").write_text('\ufeffUnnamed: 0,text,uid,org_id,"more"\n0,world,3,B,x\n')
    (tmp_path / "c.csv").write_text(",uid,org_id,text,dup,Dup\n0,4,C,last,d,D\n")
    (tmp_path / "d.csv").write_text("")
    with gzip.open(tmp_path / "e.csv.gz", "wt") as out:
        out.write("uid,text,org_id\n5,packed,D\n")
    found = scan_csv(spark, str(tmp_path), ["uid", "org_id", "text"], multi_line, ordinal="at").orderBy("at").collect()
    assert [(r["at"], r["uid"], r["org_id"], r["text"], r["more"]) for r in found] == [
        (0, "1", "A", "hello", None), (1, "2", "A", "a, b", None), (2, "3", "B", "world", "x"), (3, "4", "C", "last", None),
        (4, "5", "D", "packed", None)]
    assert [found[3][c] for c in ("_c0", "dup4", "Dup5")] == ["0", "d", "D"]


def test_a_header_longer_than_the_first_look(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_source, "HEAD_BYTES", 16)
    names = [f"column_{i}" for i in range(40)]
    for name, order in (("a", names), ("b", names[::-1])):
        (tmp_path / f"{name}.csv").write_text(",".join(order) + "\n" + ",".join(n.removeprefix("column_") for n in order) + "\n")
    rows = scan_csv(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all(r[f"column_{i}"] == str(i) for r in rows for i in range(40))


def test_partition_folders_stay_columns_when_headers_differ(spark, tmp_path):
    for day, text in (("1", "uid,v\n1,x\n"), ("2", "v,uid\ny,2\n")):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "p.csv").write_text(text)
    found = scan_csv(spark, str(tmp_path)).select("uid", "v", F.col("day").cast("string"))
    assert sorted(map(tuple, found.collect())) == [("1", "x", "1"), ("2", "y", "2")]


def test_files_with_other_headers_in_one_load(spark, store, tmp_path):
    (tmp_path / "a.csv").write_text('uid,org_id,embedding\n1,A,"[1.0]"\n')
    (tmp_path / "b.csv").write_text('embedding,note,uid,org_id\n"[2.0]",n,1,A\n"[3.0]",n,2,A\n')
    store.ensure("c", ["A"], vector_size=1)
    assert jobs.ingest_csv(store, "c", "A", str(tmp_path)) == 3
    # The row of the later file wins.
    assert content(store.points("c")) == [("A", "1", 2.0), ("A", "2", 3.0)]


def test_query_files_of_several_layouts_are_numbered_together(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n[0]\n{\"vector\": [1]}\n")
    (tmp_path / "b.json").write_text('{"vectors": [[2], {"vector": [3]}]}')
    (tmp_path / "c.json").write_text("[\n [4],\n [5]\n]")
    (tmp_path / "d.jsonl").write_text("[" + "6, " * 40_000 + "6]\n[7]\n")
    (tmp_path / "e.json").write_text(" \n")
    (tmp_path / "f.jsonl").write_text("[8, 8]\n")
    found = scan_query_vectors(spark, str(tmp_path)).orderBy("query_index").collect()
    assert [(r["query_index"], r["qvec"][0]) for r in found] == [(i, float(i)) for i in range(9)]
    assert len(found[6]["qvec"]) == 40_001 and found[8]["qvec"] == [8.0, 8.0]


def test_snapshots_of_another_vector_size_are_refused(spark, store):
    store.ensure("c", ["A"], vector_size=1)
    store.ensure("d", ["A"], vector_size=2)
    label = store.create_snapshot("c")
    with pytest.raises(ValueError, match="expects 2"):
        store.restore_snapshot("d", label, source="c")


def test_a_restore_leaves_unchanged_partitions_alone(spark, store):
    store.ensure("c", ["A", "B"], vector_size=1, buckets=1)
    store.upsert("c", points(spark, [("A", "1", 1.0, 0), ("B", "1", 2.0, 1)]))
    label = store.create_snapshot("c")
    store.upsert("c", points(spark, [("A", "1", 9.0, 2), ("A", "2", 3.0, 3)]))
    commit = {p[0]: p[2] for p in store.version("c").partitions}
    store.restore_snapshot("c", label)
    restored = {p[0]: p[2] for p in store.version("c").partitions}
    assert restored["B"] == commit["B"] and restored["A"] != commit["A"]
    assert content(store.points("c")) == [("A", "1", 1.0), ("A", "2", 3.0), ("B", "1", 2.0)]
