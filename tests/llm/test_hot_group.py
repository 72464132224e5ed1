"""Rows that a large group of near copies makes in the joins of ``order_minhash``."""

import random

import pytest
from pyspark.sql import functions as F

from shardloom.llm import order_minhash
from shardloom.llm.components import components


def _copies(rnd, base, first, count, edits):
    out = []
    for k in range(count):
        words = base[:]
        for _ in range(rnd.choice(edits)):
            words[rnd.randrange(len(words))] = f"n{rnd.random()}"
        out.append((first + k, " ".join(words)))
    return out


def _tables(spark, rows):
    made = order_minhash.sketch_texts(spark.createDataFrame(rows, "doc_id bigint, text string"))
    return made.select(F.col("at").alias("node"), "sketch"), made.select(F.col("at").alias("node"), "sketch", "words")


def _classes(links):
    out = {}
    for r in components(links).collect():
        out.setdefault(r["root"], set()).add(r["node"])
    return sorted(map(sorted, out.values()))


@pytest.fixture
def counted(monkeypatch):
    """Rows that get words, and links of which components are found."""
    seen = {"rows": 0, "links": 0}
    linked, found = order_minhash._linked, order_minhash.components

    def watched(placed, words, least):
        seen["rows"] += placed.count()
        return linked(placed, words, least)

    def watched_links(links):
        seen["links"] += links.count()
        return found(links)

    monkeypatch.setattr(order_minhash, "_linked", watched)
    monkeypatch.setattr(order_minhash, "components", watched_links)
    return seen


def test_a_group_is_moved_and_linked_once_not_for_each_sketch(spark, counted):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    nodes, words = _tables(spark, _copies(rnd, base, 0, 240, (1, 2, 4)))
    links = order_minhash.near_links(nodes, words, block=60)
    assert [len(c) for c in _classes(links)] == [240]
    assert counted["links"] <= 2 * 240
    assert counted["rows"] <= 3 * 240


def test_unlike_texts_meet_a_group_once_for_all_its_buckets(spark, counted):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    rows = _copies(rnd, base, 0, 240, (1, 2, 4))
    rows += [(1000 + k, " ".join(base[:150] + [f"u{k}x{j}" for j in range(80)])) for k in range(6)]  # half alike, with many sketches shared
    rows += _copies(rnd, base, 2000, 4, (12,)) + [(3000, " ".join(base[:7])), (3001, " ".join(base[:8]))]
    nodes, words = _tables(spark, rows)
    links = order_minhash.near_links(nodes, words, block=15)
    # One block for each bucket is brute force within candidates.
    rows_made = counted["rows"]
    assert _classes(links) == _classes(order_minhash.near_links(nodes, words, block=10_000))
    assert rows_made <= 9 * len(rows)
