"""Shards, decontamination and near-duplicates against DuckDB and brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect
from helpers import ODD_TEXTS, none, odd
from pyspark.sql import functions as F

from shardloom.llm import feistel_shards, order_minhash, queries, wu_manber
from shardloom.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, queries.QUERIES[name], queries.ORACLE[name], SF) is None


# --- shards ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 16, 17, 99, 1000, 1024])
def test_permutation_hits_every_place_once(spark, rows):
    numbers = spark.range(rows)
    got = sorted(r[0] for r in numbers.select(feistel_shards.permuted(F.col("id"), rows, 3)).collect())
    assert got == list(range(rows))


def test_shards_of_odd_rows(spark):
    for seed in (1, 2):
        got = feistel_shards.shard_rows(odd(spark).withColumn("SHARD", F.lit("old")), 4, ["doc_id"], seed).collect()
        assert sorted(r["row_number"] for r in got) == list(range(len(ODD_TEXTS)))
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["row_number"])] == [None, -9, 1, 1, 2, 3, 5, 6, 7, 8]
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(len(slots.get(k, [])) for k in range(4)) <= 1
    names = ["_at", "at", "_part", "part", "_before", "before", "_spot", "spot"]
    clash = feistel_shards.shard_rows(odd(spark).withColumns({n: F.lit(n) for n in names}), 4, ["doc_id"])
    assert set(clash.columns) >= set(names) and all(tuple(r[n] for n in names) == tuple(names) for r in clash.collect())
    assert feistel_shards.shard_rows(none(spark), 4, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        feistel_shards.shard_rows(none(spark), 0, ["doc_id"])


def test_many_equal_rows_are_dealt_out(spark):
    rows = spark.range(4000).select(F.lit(1).alias("doc_id"))
    got = feistel_shards.shard_rows(rows, 7, ["doc_id"])
    assert got.select("row_number").distinct().count() == 4000
    assert {n for _, n in Counter(r["shard"] for r in got.collect()).items()} <= {571, 572}


def test_shards_are_written_in_slot_order(spark, tmp_path):
    feistel_shards.write_shards(feistel_shards.shard_rows(spark.range(50), 3, ["id"]), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in back.collect()) == list(range(50))


# --- decontamination -------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _expected_hits(text, items):
    words, hit, held = _plain_words(text), set(), set()
    for item, item_text in items:
        own = _plain_words(item_text)
        if not own:
            continue
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                held.add(str(item))
    return len(words), len(hit), sorted(held)


ITEMS = [(1, "A b c"), (2, None), (3, ""), (4, "x"), (5, "The QUICK brown fox"), (5, "the quick brown fox"), (6, "ñ é"), (7, "... !"),
         (8, "b b b b b b b b b b b"), (9, "one two three four five six seven eight nine ten eleven twelve")]


def test_hits_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(["a", "b", "B", "c", "x", "one two three four five six seven", "eight nine ten", "eleven", "ñ é", "the quick brown-fox"], k=rnd.randint(0, 25)))
             for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [r[:2] for r in ODD_TEXTS]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, hit_items string")
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for share in (wu_manber.SHARE_BYTES, 100):  # one pass, and many
        got = wu_manber.find_items(docs, benchmark, share_bytes=share).collect()
        for r in got:
            n, hit, held = _expected_hits(r["text"], ITEMS)
            assert (r["n_words"], sum(b - a for a, b in r["hit_spans"]), r["hit_items"]) == (n, hit, held), r["text"]
        assert len(got) == len(rows)


def test_no_items_and_no_documents(spark):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert wu_manber.drop_contaminated(odd(spark), benchmark).count() == len(ODD_TEXTS)
    assert wu_manber.report(wu_manber.find_items(none(spark), benchmark)).count() == 0
    kept = wu_manber.drop_contaminated(odd(spark), spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    assert kept.columns == ["doc_id", "text", "score", "ids", "lang"]
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, None, 6, 7, 8, -9}


# --- near-duplicates -------------------------------------------------------------------------------------------------


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = max(last[j + 1], row[j], last[j] + (x == y))
    return row[-1]


def _text(values):
    return order_minhash.Text(order_minhash.pack_words(np.array(values, np.uint32)))


def test_alignment_equals_full_table():
    rnd = random.Random(0)
    for _ in range(600):
        a = [rnd.randint(0, rnd.choice([3, 30, 1000])) for _ in range(rnd.randint(1, 40))]
        b = a[:]
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randint(0, 2)] = [rnd.randint(0, 1000) for _ in range(rnd.randint(0, 3))]
        if rnd.random() < 0.3:
            k = rnd.randrange(len(b) + 1)
            b = b[k:] + b[:k]
        x, y = _text(a), _text(b)
        if x.size and y.size:
            enough = _lcs(x.plain.tolist(), y.plain.tolist()) >= 0.8 / 1.8 * (x.size + y.size) - 1e-9
            assert order_minhash.alike(x, y) == enough
            assert order_minhash.banded_lcs(x.plain, y.plain, 100) == _lcs(x.plain.tolist(), y.plain.tolist())


def test_a_passage_repeated_on_one_side_is_aligned(spark):
    front, back = [f"p{i}" for i in range(80)], [f"q{i}" for i in range(20)]
    plain, twice = front + back, back + front + back
    x, y = (_text(order_minhash.word_hashes([w.encode() for w in words])) for words in (plain, twice))
    assert (x.repeats, y.repeats, _lcs(x.plain.tolist(), y.plain.tolist())) == (False, True, 100)
    assert order_minhash.alike(x, y) and order_minhash.alike(y, x)
    docs = spark.createDataFrame([(1, " ".join(plain)), (2, " ".join(twice))], "doc_id bigint, text string")
    assert _got_classes(order_minhash.classes(docs)) == [(1, 1, 2), (2, 1, 2)]
    rnd, found = random.Random(8), 0
    for _ in range(300):
        a = [rnd.randint(0, 10**6) for _ in range(rnd.randint(20, 60))]
        i = rnd.randrange(len(a) - 5)
        b = a[:]
        j = rnd.randrange(len(a))
        b[j:j] = a[i : i + rnd.randint(5, 15)]
        if rnd.random() < 0.3:
            b = b * 9  # many equal places
            a = a * 9
        x, y = _text(a), _text(b)
        enough = _lcs(x.plain.tolist(), y.plain.tolist()) >= 0.8 / 1.8 * (x.size + y.size) - 1e-9
        assert order_minhash.alike(x, y) == order_minhash.alike(y, x) == enough
        found += enough
    assert 20 < found < 280


def test_short_near_copies_share_a_sketch():
    missed = 0
    for k in range(4000):
        words = [f"t{k}w{i}".encode() for i in range(9)]
        x, y = (order_minhash.kmers(order_minhash.word_hashes(w))[1] for w in (words[:8], words))
        a, b = order_minhash.all_sketches(x), order_minhash.all_sketches(y)
        assert len(a) == len(b) == order_minhash.SKETCHES + order_minhash.SHORT_SKETCHES
        missed += not any(map(int.__eq__, a, b))
    assert missed == 0
    for size, more in ((order_minhash.SHORT, order_minhash.SHORT_SKETCHES), (order_minhash.SHORT + 1, 0)):
        assert len(order_minhash.all_sketches(np.arange(size, dtype=np.uint64))) == order_minhash.SKETCHES + more


def test_short_and_long_texts_of_one_bucket(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[: 40 + k])) for k in range(9)]  # 36 to 44 k-mers
    rows += [(100 + k, " ".join(f"s{k}x{i}" for i in range(8 + d))) for k in range(30) for d in (0, 1)]
    got = _got_classes(order_minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == sorted([(k, 0, 9) for k in range(9)] + [(100 + k, 100 + k, 2) for k in range(30) for _ in (0, 1)])


def _expected_classes(rows):
    """Classes by comparing every text with every other."""
    texts = defaultdict(list)
    for at, (key, text) in enumerate(rows):
        words = tuple(order_minhash.words_of((text or "").encode()))
        texts[("null", at) if text is None else words or ("raw", text)].append(key)
    names = list(texts)
    made = [_text(order_minhash.word_hashes(list(n)).tolist() if n and isinstance(n[0], bytes) else []) for n in names]
    root = list(range(len(names)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(names)):
        for j in range(i):
            if find(i) != find(j) and order_minhash.alike(made[i], made[j]):
                root[find(i)] = find(j)
    out = defaultdict(list)
    for k, n in enumerate(names):
        out[find(k)] += texts[n]
    return sorted((key, min((x for x in ks if x is not None), default=None), len(ks)) for ks in out.values() for key in ks if key is not None)


def _got_classes(df):
    return sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in df.collect() if r["doc_id"] is not None)


def test_op10_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _got_classes(queries.op10_order_minhash(spark, SF)) == _expected_classes(rows)


def _similar(a, b):
    """Matched words of the best alignment over all of them, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            above = row[j + 1]
            row[j + 1] = max(left + (x == y), above, row[j])
            left = above
    return row[-1] / (len(a) + len(b) - row[-1])


def _edited(rnd, words, share):
    out = []
    for w in words:
        if rnd.random() >= share:
            out.append(w)
        elif rnd.random() < 0.6:
            out.append(f"n{rnd.randrange(10**6)}")
        elif rnd.random() < 0.5:
            out += [w, f"n{rnd.randrange(10**6)}"]
    return out


def test_copies_with_edited_words_are_linked(spark):
    rnd = random.Random(12)
    common = [f"c{i}" for i in range(40)]
    rows, want = [], {}
    for k in range(480):
        base = [rnd.choice(common) if rnd.random() < 0.5 else f"w{rnd.randrange(20000)}" for _ in range(rnd.randint(80, 300))]
        share = (0.01, 0.02, 0.05, 0.08, 0.1, 0.3)[k % 6]
        copy = _edited(rnd, base, share)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        want[2 * k] = share, _similar(base, copy)
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = defaultdict(list)
    for k, (share, similarity) in want.items():
        linked = got[k] == got[k + 1] == (k, 2)
        assert linked or got[k] == (k, 1) and got[k + 1] == (k + 1, 1)
        if similarity >= 0.8:
            found[share].append(linked)
        else:
            assert not linked
    assert all(len(found[share]) > 30 for share in (0.01, 0.02, 0.05, 0.08))
    for share, linked in found.items():
        assert sum(linked) >= 0.9 * len(linked), share


def test_near_copies_of_the_documents_are_linked(spark):
    """Pairs with many 3-word runs in common, aligned apart."""
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    words = {r["doc_id"]: re.findall(r"[0-9a-z\x80-\U0010ffff]+", r["text"].lower()) for r in docs}
    places = defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - 2):
            places[tuple(w[i : i + 3])].add(k)
    shared = Counter((a, b) for ks in places.values() if 1 < len(ks) < 200 for a in ks for b in ks if a < b)
    near = [(a, b) for (a, b), n in shared.items() if n > 0.4 * min(len(words[a]), len(words[b])) and words[a] != words[b]
            and max(len(words[a]), len(words[b])) < 3000 and _similar(words[a], words[b]) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in queries.op10_order_minhash(spark, path).collect()}
    assert len(near) > 80 and sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)
    # Texts of one class are connected by such pairs or equal words.
    root = {k: k for k in words}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    seen = {}
    for a, b in near + [(seen.setdefault(tuple(w), k), k) for k, w in words.items() if w]:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(k) == find(got[k]) for k in words if words[k] and len(words[k]) < 3000)


def _family(rnd, base, edits):
    words = base[:]
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"n{rnd.random()}"
    return " ".join(words)


def test_blocks_of_a_large_bucket_lose_no_link(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(200)]
    rows = [(k, _family(rnd, base, rnd.choice([1, 2, 4, 9, 16]))) for k in range(90)]
    rows += [(100 + k, " ".join(base[:60] + [f"u{k}x{j}" for j in range(90)])) for k in range(30)]  # a shared passage only
    rows += [(200, " ".join(base[100:] + base[:100])), (201, " ".join(base)), (202, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    base_rows = order_minhash.sketch_texts(docs)
    nodes = base_rows.groupBy("text_key").agg(F.min(F.struct("at", "sketch")).alias("m")).select(F.col("m.at").alias("node"), "m.sketch")
    words = base_rows.select(F.col("at").alias("node"), "sketch", "words")
    want = {tuple(sorted(g)) for g in _groups(order_minhash.near_links(nodes, words, block=10_000))}
    for block in (2, 7, 25):
        assert {tuple(sorted(g)) for g in _groups(order_minhash.near_links(nodes, words, block=block))} == want
    assert _got_classes(order_minhash.classes(docs)) == _expected_classes(rows)


def test_blocks_of_long_texts_are_bounded_in_bytes(spark, monkeypatch):
    rnd = random.Random(6)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(2000)]
    docs = spark.createDataFrame([(k, _family(rnd, base, 3)) for k in range(40)], "doc_id bigint, text string")
    base_rows = order_minhash.sketch_texts(docs)
    nodes, words = base_rows.select(F.col("at").alias("node"), "sketch"), base_rows.select(F.col("at").alias("node"), "sketch", "words")
    most, plain = [], order_minhash._linked

    def watched(placed, words, least):
        sizes = placed.join(words, "node").groupBy("group").agg(F.sum(F.octet_length("words")).alias("b"))
        most.append(sizes.agg(F.max("b")).first()[0] or 0)
        return plain(placed, words, least)

    monkeypatch.setattr(order_minhash, "_linked", watched)
    links = order_minhash.near_links(nodes, words, block_bytes=60_000)  # 40 texts of 6,000 bytes
    assert max(most) < 160_000
    assert [len(g) for g in _groups(links)] == [40]


def _groups(links):
    out = defaultdict(set)
    for r in components(links).collect():
        out[r["root"]].add(r["node"])
    return out.values()


def test_classes_of_odd_rows(spark):
    assert _got_classes(order_minhash.classes(odd(spark))) == _expected_classes([r[:2] for r in ODD_TEXTS])
    kept = order_minhash.keep_first(odd(spark))
    assert kept.columns == ["doc_id", "text", "score", "ids", "lang"]
    clash = order_minhash.keep_first(odd(spark).withColumns({"row": F.lit("mine"), "_row": F.lit("too"), "FIRST": F.lit(3)}))
    assert {(r["row"], r["_row"], r["FIRST"]) for r in clash.collect()} == {("mine", "too", 3)} and clash.count() == kept.count()
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [1, 2, 3, None, 5, 6, 7, 8, -9]))
    assert order_minhash.classes(none(spark)).count() == order_minhash.keep_first(none(spark)).count() == 0


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_components_equal_union_find(spark, monkeypatch, sent):
    monkeypatch.setattr("shardloom.llm.components.BROADCAST_LINKS", sent)
    rnd = random.Random(4)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in pairs:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    linked = {n for u, v in pairs if u != v for n in (u, v)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {n: find(n) for n in linked}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
