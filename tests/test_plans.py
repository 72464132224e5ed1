"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from shardloom.catalog import inputs
from shardloom.operators import chunk, prepare, search

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    "assign_point_ids", "backup_manifest", "build_payload", "chunk_markdown", "chunk_records", "chunk_recursive",
    "chunk_words", "clean_markdown", "dedupe_first", "dedupe_last", "dim_violations", "embed_documents", "embed_text",
    "embeddable_text", "ensure_report", "fill_text_from_doc", "filter_tenant", "hash_embed", "import_tenant_filter",
    "import_violations", "knn_blocked", "knn_exact", "knn_filtered", "knn_ivf", "knn_tenant", "label_results",
    "load_report", "match_filter", "nest_results", "normalize_vectors", "overlay_embeddings", "parse_vectors",
    "prefix_text", "project_payload", "project_vectors", "prune_columns", "prune_payload_keys", "registry_diff",
    "replace_tenant_slice", "sanitize_numbers", "save_registry", "tenant_anti", "tenant_except", "tenant_intersect",
    "tenant_semi", "tenants_by_collection", "token_count",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_window_over_everything(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for line in text.splitlines():
        if "Window [" in line:
            assert not re.search(r"\], \[\], \[", line), line


@pytest.mark.parametrize("name", ["chunk_words", "chunk_markdown", "hash_embed", "embed_documents", "parse_vectors",
                                  "build_payload", "assign_point_ids", "sanitize_numbers", "clean_markdown"])
def test_row_local_work_does_not_shuffle(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "hashpartitioning" not in text and "rangepartitioning" not in text


def test_costly_expressions_run_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("uid", F.col("doc_id").cast("string"))
    text = plan(chunk.chunk_words(docs, size=10, overlap=2, min_words=1))
    assert text.count("split(") == 1
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.to_json("embedding").alias("embedding"))
    assert plan(prepare.parse_vectors(vectors)).count("from_json") == 1


def test_top_k_is_limited_before_the_shuffle(spark):
    text = plan(search.knn_exact(inputs.vector_points(spark, SF), inputs.source_queries(spark, SF), 3))
    assert text.count("WindowGroupLimit") == 2 and "Join" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(contract.queries()["knn_exact"](spark, SF))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in text
    text = plan(contract.queries()["tenants_by_collection"](spark, SF))
    assert "ReadSchema: struct<lang:string,source:string>" in text


def test_one_tenant_reads_only_its_folders(spark):
    store = inputs.vector_store(spark, SF, "plan")
    points = store.points("points", "T3")
    assert "PartitionFilters" in plan(points) and "tenant" in plan(points)
    files = points.select(F.col("_metadata.file_path")).distinct().collect()
    assert files and all("tenant=T3/" in row[0] for row in files)


def test_known_small_sides_are_broadcast(spark):
    points, queries = inputs.vector_points(spark, SF), inputs.tenant_queries(spark, SF)
    text = plan(search.knn_blocked(points, queries, 5, group="tenant"))
    assert text.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("name", ["knn_tenant", "knn_ivf", "knn_exact"])
def test_search_does_not_shuffle_the_points(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "FlatMapCoGroups" not in text
    # Hits meet to be ranked; nothing else moves.
    assert [line.count("query_index") for line in text.splitlines() if "Exchange" in line] == [1]
