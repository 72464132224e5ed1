import random

from pyspark.sql import functions as F

from shardloom.operators import chunk, joins, prepare, reports, validate


def collect(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


def test_tenant_filter_exact_and_trimmed(rows):
    df = rows("i int, org_id string", [(1, "a"), (2, " a "), (3, "b"), (4, None)])
    assert collect(prepare.filter_tenant(df, "a"), "i") == [(1,)]
    assert collect(prepare.filter_tenant(df, "a", trim=True), "i") == [(1,), (2,)]


def test_payload_projection(spark):
    df = spark.range(1).select(F.parse_json(F.lit('{"a":1,"Unnamed: 0":2,"b":{"c":3}}')).alias("payload"))
    text = F.to_json("payload")
    assert collect(prepare.prune_payload_keys(df), text) == [('{"a":1,"b":{"c":3}}',)]
    assert collect(prepare.project_payload(df, " b, zz ,"), text) == [('{"b":{"c":3}}',)]
    assert collect(prepare.project_payload(df, " , "), text) == collect(df, text)
    assert prepare.payload_keys(None) is None


def test_match_filter_prefers_columns(spark):
    df = spark.range(1).select(F.lit("x").alias("filename"), F.parse_json(F.lit('{"filename":"y","k.l":"v"}')).alias("payload"))
    assert prepare.match_filter(df, {"filename": "x", "k.l": "v"}).count() == 1
    assert prepare.match_filter(df, {"filename": "y"}).count() == 0


WINDOWS = [
    (3, 1, [(1, 3)]),
    (4, 1, [(1, 4)]),
    (10, 2, [(1, 4), (4, 7), (7, 10)]),
    (11, 2, [(1, 4), (4, 7), (7, 10), (10, 11)]),
    (11, 3, [(1, 4), (4, 7), (7, 10)]),
    (0, 1, []),
]


def test_word_windows(rows):
    for tokens, least, spans in WINDOWS:
        words = [f"w{i}" for i in range(1, tokens + 1)]
        df = rows("uid string, text string, other int", [("u", " ".join(words), 7)])
        found = chunk.chunk_words(df, size=4, overlap=1, min_words=least).orderBy("chunk_index").collect()
        assert [r["text"] for r in found] == [" ".join(words[a - 1:b]) for a, b in spans]
        for i, row in enumerate(found, start=1):
            assert (row["chunk_index"], row["chunk_count"], row["other"]) == (i, len(spans), 7)
            expected = (f"u_{i}", "u") if len(spans) > 1 else ("u", None)
            assert (row["uid"], row["parent_uid"]) == expected


def test_windows_cover_every_word(rows):
    words = [f"w{i}" for i in range(997)]
    df = rows("uid string, text string", [("u", "  ".join(words))])
    found = chunk.chunk_words(df, size=13, overlap=5, min_words=0).select(F.explode(F.split("text", " "))).distinct()
    assert found.count() == len(words)


def test_missing_uid_stays_missing(rows):
    df = rows("uid string, text string", [(None, "a b c d e"), (" ", "a b c d e")])
    found = chunk.chunk_words(df, size=2, overlap=0, min_words=1)
    assert found.count() == 6 and found.where("parent_uid IS NOT NULL").count() == 0


def test_markdown_windows_stop_at_headings(rows):
    df = rows("uid string, text string", [("u", "intro text\n# One\na b c d\n## Two\ne\n#not a heading")])
    found = chunk.chunk_markdown(df, size=4, overlap=1, min_words=1).orderBy("chunk_index")
    assert [r["text"] for r in found.collect()] == [
        "intro text", "# One", "a b c d", "## Two\ne", "e\n#not a heading"]


def test_recursive_split_prefers_headings_and_keeps_the_overlap():
    text = "# A\none two three\n# B\nfour five six seven eight nine"
    assert chunk.split_recursively(text, 5, 2, chunk.count_words) == [
        "# A\none two three", "# B", "four five six seven eight", "seven eight nine"]


def test_recursive_split_leaves_one_long_word_whole():
    assert chunk.split_recursively("abcdefgh", 3, 1, len) == ["abcdefgh"]


def test_recursive_chunks(rows):
    df = rows("uid string, text string", [("u", "a b c d e f g"), ("v", None), ("w", "![i](j)")])
    found = chunk.chunk_recursive(df, size=3, overlap=1, min_tokens=2).orderBy("chunk_index").collect()
    assert [(r["uid"], r["text"]) for r in found] == [("u_1", "a b c"), ("u_2", "c d e"), ("u_3", "e f g")]


def test_windows_equal_the_plain_splitter(rows):
    rnd = random.Random(1)
    parts = ["\n# H", "\n## G", "\n### F", "\n\n", "\n", "\n\n\n", " ", "\t", "#### x", "\n###### z"]
    texts = ["".join(rnd.choice([f"w{rnd.randrange(9)}"] * 8 + parts) + rnd.choice([" ", " ", ""]) for _ in range(rnd.randint(0, 40)))
             for _ in range(120)] + ["", "  ", "abcdefgh", "\\E# x \\Q", None]
    df = rows("i int, t string", list(enumerate(texts)))
    for size, overlap, least in ((5, 2, 1), (9, 0, 3), (14, 6, 0), (1, 0, 1)):
        got = dict(df.select("i", chunk.markdown_windows(F.col("t"), size, overlap, least)).collect())
        for i, text in enumerate(texts):
            want = chunk.split_recursively(text, size, overlap, chunk.count_words) if text else []
            assert got[i] == [w for w in want if chunk.count_words(w) >= least], text


def test_neighbouring_windows_share_whole_pieces(rows):
    text = "\n".join(f"# {i}\na{i} b{i}" for i in range(9))  # four words each
    found = rows("t string", [(text,)]).select(F.explode(chunk.markdown_windows(F.col("t"), 13, 7, 1)).alias("w")).collect()
    spans = [(int(r["w"].split()[1]), int(r["w"].split()[-3])) for r in found]
    assert spans == [(0, 2), (2, 4), (4, 6), (6, 8)]


def test_windows_of_many_blocks_of_pieces(rows):
    text = "\n## ".join(f"word{i} of a section" for i in range(3 * chunk.PIECES_PER_BLOCK + 5))
    got = rows("t string", [(text,)]).select(chunk.markdown_windows(F.col("t"), 40, 10, 1)).first()[0]
    assert got == chunk.split_recursively(text, 40, 10, chunk.count_words)


def test_overlay(rows):
    old = rows("uid string, embedding string", [("u1", None), ("u2", "v2")])
    new = rows("uid string, embedding string", [("u1", "n1"), ("u2", None), ("u3", "n3"), ("u1", "n0")])
    assert collect(joins.overlay_embeddings(old, new), "uid", "embedding") == [("u1", "n1"), ("u2", "v2")]


def test_replace_tenant_slice(rows):
    table = rows("org_id string, a int", [("x", 1), ("y", 2), (None, 3)])
    new = rows("org_id string, b int", [("x", 9)])
    found = joins.replace_tenant_slice(table, new, "x")
    assert {tuple(r) for r in found.collect()} == {("y", 2, None), (None, 3, None), ("x", None, 9)}


def test_snapshot_restore(rows):
    keys = ("id",)
    snapshot = rows("id int, v string", [(1, "s1"), (2, "s2")])
    current = rows("id int, v string", [(2, "r2"), (3, "r3")])
    assert collect(joins.snapshot_restore(snapshot, current, "snapshot", keys), "id", "v") == [(1, "s1"), (2, "s2"), (3, "r3")]
    assert collect(joins.snapshot_restore(snapshot, current, "replica", keys), "id", "v") == [(1, "s1"), (2, "r2"), (3, "r3")]


def test_registry_reports(rows):
    requested = rows("collection string, tenant string", [("c", "b"), ("c", "a"), ("c", ""), ("c", "b")])
    existing = rows("collection string, tenant string", [("c", "a"), ("d", "b")])
    assert collect(joins.ensure_report(requested, existing), "tenant", "status") == [("a", "skipped"), ("b", "created")]
    assert collect(joins.delete_report(requested, existing), "tenant", "status") == [("a", "deleted"), ("b", "skipped")]


def test_dedupe(rows):
    df = rows("v string, pos int", [("b", 0), ("a", 1), ("", 2), ("b", 3), (None, 4)])
    assert collect(reports.dedupe_first(df, "v", "pos"), "v", "pos") == [("a", 1), ("b", 0)]


def test_load_report(rows):
    df = rows("a int, t string", [(1, "x"), (2, ""), (3, "x"), (3, "")])
    out = reports.load_report(df, {"blank": F.col("t") == "", "three": F.col("a") == 3}).first()
    assert tuple(out) == (4, 1, 2, 1)


def test_manifest_without_tenants(rows):
    df = rows("tenant string", [(None,), (None,)])
    assert reports.backup_manifest(df).first().asDict() == {"points_total": 2, "points_per_shard": {"__default__": 2}}
    assert reports.backup_manifest(df.limit(0)).first()["points_total"] == 0


def test_dim_violations(rows):
    df = rows("i int, vector array<double>", [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0])])
    assert collect(validate.dim_violations(df, 2), "i", "reason") == [
        (2, "dimension 1 != expected 2"), (3, "missing vector"), (4, "zero vector")]
