"""Queries on tables of their own rows, against the same SQL in DuckDB."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as contract
from compare import compare
from shardloom.catalog import inputs, queries
from shardloom.sinks import writers
from shardloom.sources import files


def opposite_words(dim=32):
    """Two words of one bucket and opposite signs."""
    found = defaultdict(dict)
    for i in range(10_000):
        digest = hashlib.md5(f"w{i}".encode()).hexdigest()
        signs = found[int(digest[:8], 16) % dim]
        signs[digest[8] < "8"] = f"w{i}"
        if len(signs) == 2:
            return signs[True], signs[False]


@pytest.fixture
def documents(spark, tmp_path):
    """``documents(texts)``: a folder with them as ``documents``, and DuckDB on it."""

    def write(texts):
        schema = "doc_id bigint, text string, lang string, source string, n_chars int"
        rows = [(i, text, "en", f"src{i % 3}", len(text or "")) for i, text in enumerate(texts)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        return str(tmp_path), con

    return write


@pytest.mark.parametrize("name", ["hash_embed", "embed_text", "embed_documents", "stream_embed"])
def test_words_that_cancel_out_give_a_row_without_vector(spark, documents, name):
    plus, minus = opposite_words()
    sf_dir, con = documents([f"{plus} {minus} " * 6, "a b c d e f g h i j k", None, " \n ", "nan", f"{plus} " * 12, "x y"])
    sql = contract.oracle_sql()[name]
    assert len(con.sql(f"SELECT * FROM ({sql}) WHERE dim IS NULL").fetchall()) == 1
    assert compare(spark, con, contract.queries()[name], sql, sf_dir) is None


@pytest.mark.parametrize("name", ["scan_csv", "row_ordinal", "scan_csv_headers", "embed_upsert", "job_load_report"])
def test_more_text_makes_more_files(spark, documents, monkeypatch, name):
    monkeypatch.setattr(inputs, "FILE_BYTES", 2_000)
    sf_dir, con = documents([f'line {i}\n"quoted", {"word " * 20}' for i in range(400)])  # about 46,000 bytes
    written = []
    write = writers.write_csv
    monkeypatch.setattr(writers, "write_csv", lambda df, path: (written.append(path), write(df, path)))
    assert compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], sf_dir) is None
    assert len(files.listed(spark, written)) >= 20


def test_arrivals_are_files_of_bounded_size(spark, documents, monkeypatch):
    monkeypatch.setattr(inputs, "FILE_BYTES", 2_000)
    sf_dir, con = documents([f"text {i} {'word ' * 20}" for i in range(200)])
    roots = []
    named = queries.scratch_path
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: (roots.append(named(spark, name)), roots[-1])[1])
    assert compare(spark, con, contract.queries()["stream_embed"], contract.oracle_sql()["stream_embed"], sf_dir) is None
    assert len(spark.read.parquet(roots[0]).inputFiles()) >= 10
