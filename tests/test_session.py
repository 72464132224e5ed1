from pyspark.sql import functions as F

from shardloom import session


def test_local_tables_know_their_size(spark):
    df = session.local_table(spark, [(1, "a", [1.0]), (2, None, None)], "i int, s string, v array<double>")
    assert [tuple(r) for r in df.collect()] == [(1, "a", [1.0]), (2, None, None)]
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    assert session.local_table(spark, [], "i int").count() == 0


def test_only_small_tables_are_marked_for_broadcast(spark):
    big = spark.range(1000)
    for limit, broadcast in ((10, False), (1000, True)):
        joined = spark.range(5).join(session.local_if_small(big, limit), "id")
        assert joined.count() == 5
        assert ("hint=broadcast" in joined._jdf.queryExecution().optimizedPlan().toString()
                or "strategy=broadcast" in joined._jdf.queryExecution().optimizedPlan().toString()) == broadcast


def test_narrow_scans_are_spread_and_wide_ones_left(spark):
    narrow = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert session.spread_if_narrow(narrow).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, 1, 64)
    assert session.spread_if_narrow(wide) is wide


def test_written_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    df = session.materialize(spark.range(10), "t")
    assert df.count() == 10
    assert all(folder in r[0] for r in df.select(F.input_file_name()).collect())
