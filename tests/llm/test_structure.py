"""Conversations and periodic runs against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from helpers import ODD_TEXTS, none, odd
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.llm import conversation_repair, periodic_runs, queries

SF = "/root/testdata/sf0.001"
CONTENT = re.compile(r"[^\x20\x09-\x0D]")

# --- conversations -----------------------------------------------------------------------------------------------------


def _cheapest(rows):
    """(cost, audit, repaired) of (role, text, must go, truncated) rows: uniform-cost search over all edits, audits in order."""
    queue = [(0, "", 0, "", ())]
    best = {}
    while queue:
        cost, audit, at, made, out = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", made):
            return cost, audit, out
        if not re.fullmatch(r"s?(ua)*u?", made) or best.get((at, made), (cost, audit)) < (cost, audit):
            continue
        best[at, made] = cost, audit
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 3, audit + "I", at, made + role[0], (*out, f"{role}:")))
        if at == len(rows):
            continue
        role, text, gone, cut = rows[at]
        heapq.heappush(queue, (cost + 4, audit + "D", at + 1, made, out))
        if not gone:
            heapq.heappush(queue, (cost + 3 * cut, audit + "K", at + 1, made + (role[:1] or "?"), (*out, f"{role}:{text}")))
            for new in ("user", "assistant"):
                heapq.heappush(queue, (cost + 3 + 3 * cut, audit + "R", at + 1, made + new[0], (*out, f"{new}:{text}")))


def _classified(rows):
    """(role, text, fault) in order."""
    seen, out = set(), []
    for role, text in rows:
        content = CONTENT.findall(text)
        fault = "blank" if not content else "duplicate" if (role, text) in seen else "truncated" if content[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def _expected(rows, damage):
    """Result rows by conversation from (conv, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        group = groups[conv]
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        row = (turn is not None, turn or 0, "user" if case == 4 else role, hashlib.md5(text.encode()).hexdigest(), text)
        group.extend([row] * (1 + (case == 3)))
    out = {}
    for conv, group in groups.items():
        group.sort()
        turns = {t for there, t, *_ in group if there}
        found = _classified([(role, text) for _, _, role, _, text in group])
        cost, audit, lines = _cheapest([(r, t, f in ("blank", "duplicate"), f == "truncated") for r, t, f in found])
        initials = [r[:1] for r, _, _ in found]
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            **{kind: sum(f == kind for *_, f in found) for kind in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(), "lines": lines,
        }
    return out


def _same(got, want):
    assert len(got) == len(want) and {r["conv_id"] for r in got} == set(want)
    for r in got:
        expected = {k: v for k, v in want[r["conv_id"]].items() if k != "lines"}
        assert {k: r[k] for k in expected} == expected


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op12_equals_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversation_repair(spark, path)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    _same([r.asDict() for r in got.collect()], _expected(rows, True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(["", "t", "b"])), max_size=8), st.sampled_from([1, 2, 3, 4]))
def test_blocks_of_any_size_give_the_least_audit(rows, block):
    symbols = bytes(conversation_repair.MUST_GO if f == "b" else 2 * "suax".index(r) + (f == "t") for r, f in rows)
    want = _cheapest([(r, "", f == "b", f == "t") for r, f in rows])
    assert BLOCKS[block].repair(symbols) == want[:2]


BLOCKS = {b: conversation_repair.Tables(b) for b in (1, 2, 3, 4)}


def test_tables_are_small_and_long_conversations_linear():
    found = conversation_repair.tables()
    assert len(found.vectors) < 100 and len(found.jump[0]) == 9**4
    rnd = random.Random(3)
    symbols = bytes(rnd.randrange(9) for _ in range(300_000))
    cost, audit = found.repair(symbols)
    single = BLOCKS[1].repair(symbols)
    assert (cost, audit) == single
    assert len(found.traces) <= 9**4 * len(found.vectors) * 4


ODD_TURNS = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "system", "Be good."), (1, 1, "assistant", "No end"), (1, 7, "User", "Odd role."),
    (2, None, None, None), (3, 5, "assistant", "  "), (3, 5, "", "no role."), (None, 0, "user", "No conversation."),
    (None, 1, "assistant", "None."), (4, 2, "user", "x " * 50_000 + "."), (4, 3, "assistant", " "), (5, 9, "tool", "Result!"),
    (-6, 1, "user", "Same."), (-6, 2, "user", "Same."), (-6, 3, "assistant", "Same."),
]


def test_conversations_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(ODD_TURNS)], "conv_id bigint, turn bigint, role string, text string, conv int, plan string")
    for damage in (False, True):
        rows = conversation_repair.read_rows(df)
        rows = conversation_repair.damage_rows(rows) if damage else rows
        want = _expected(ODD_TURNS, damage)
        plans = conversation_repair.repair_plans(rows)
        got = conversation_repair.repair_digests(rows, plans).withColumnRenamed("conv", "conv_id")
        _same([r.asDict() for r in got.collect()], want)
        lines = defaultdict(list)
        for r in sorted(conversation_repair.repaired_rows(rows, plans).collect(), key=lambda r: r["position"]):
            assert r["position"] == len(lines[r["conv"]])
            lines[r["conv"]].append(f"{r['role']}:{r['text']}")
        assert {k: tuple(v) for k, v in lines.items()} == {k: v["lines"] for k, v in want.items() if v["lines"]}
    empty = conversation_repair.read_rows(df.limit(0))
    assert conversation_repair.repair_digests(conversation_repair.damage_rows(empty)).count() == 0
    assert conversation_repair.repaired_rows(empty).count() == 0


def test_one_conversation_over_many_ranges(spark):
    rnd = random.Random(5)
    rows = [(7, rnd.randrange(60), rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", "c!", "", "d?"])) for _ in range(120)]
    rows += [(8, 1, "user", "again.")] * 40
    df = spark.createDataFrame(rows, "conv_id int, turn bigint, role string, text string")
    read = conversation_repair.read_rows(df)
    pieces = conversation_repair._pieces(conversation_repair.symbol_rows(read)).where("conv = 7").count()
    assert pieces > 3
    plan = conversation_repair.repair_plans(read).where("conv = 7").first()
    group = sorted((t, r, hashlib.md5(x.encode()).hexdigest(), x) for c, t, r, x in rows if c == 7)
    found = _classified([(r, x) for _, r, _, x in group])
    symbols = bytes(conversation_repair.MUST_GO if f in ("blank", "duplicate") else 2 * "sua".index(r[0]) + (f == "truncated") for r, _, f in found)
    assert (plan["cost"], plan["audit"]) == BLOCKS[1].repair(symbols)
    turns = {t for t, *_ in group}
    assert (plan["rows"], plan["gaps"]) == (120, max(turns) - min(turns) + 1 - len(turns))


# --- periodic runs --------------------------------------------------------------------------------------------------------


def _runs(words):
    """Every run, by comparing each word with the one a period before."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _tail(key, words):
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def _report(key, text, damage):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = _tail(key, words) if damage else words
    runs = _runs(words)
    top = None
    for run in runs:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (key, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def _in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[6:]))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_equals_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").where("length(text) < 12000").collect()
    got = queries.op13_periodic_runs(spark, path)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = _in_order(_report(k, t, True) for k, t in docs)
    keys = {k for k, _ in docs}
    assert _in_order(r for r in got.collect() if r[0] in keys) == want
    assert sum(r[1] for r in want) > 10


def _word_lists():
    letters = st.integers(0, 2)
    piece = st.tuples(st.lists(letters, min_size=1, max_size=9), st.integers(1, 9)).map(lambda p: p[0] * p[1])
    return st.lists(piece, max_size=6).map(lambda ps: [b"%d" % x for p in ps for x in p])


@settings(max_examples=400, deadline=None)
@given(st.lists(_word_lists(), max_size=4))
def test_runs_equal_brute_force(texts):
    assert periodic_runs.runs_of(texts) == [_runs(words) for words in texts]


def test_runs_with_periods_inside_periods():
    rnd = random.Random(11)
    for _ in range(300):
        inner = [rnd.randrange(2) for _ in range(rnd.randint(1, 4))] * rnd.randint(1, 9)
        period = inner + [rnd.randrange(4) for _ in range(rnd.randint(0, 5))] + inner[: rnd.randint(0, len(inner))]
        words = [b"%d" % x for x in (period * 7)[: rnd.randint(1, 7 * len(period))]]
        words = [b"x"] * rnd.randint(0, 7) + words + [b"y"] * rnd.randint(0, 7)
        assert periodic_runs.runs_of([words, words[1:]]) == [_runs(words), _runs(words[1:])]


def test_range_successor_equals_sorting():
    rnd = random.Random(1)
    import numpy as np
    values = list(range(200))
    rnd.shuffle(values)
    matrix = periodic_runs.WaveletMatrix(np.array(values))
    ranges = [(lo, rnd.randint(lo, 200), rnd.randrange(200)) for lo in (rnd.randrange(200) for _ in range(500))]
    lo, hi, x = (np.array(c, np.int32) for c in zip(*ranges))
    got = matrix.successor(lo, hi, x, -1).tolist()
    assert got == [min((v for v in values[a:b] if v > c), default=-1) for a, b, c in ranges]


def test_runs_of_odd_rows(spark):
    rows = [r for r in ODD_TEXTS if r[0] != 6]
    clash = "doc_id bigint, text string, runs double, key int, collapsed string"
    df = spark.createDataFrame(rows, clash)
    for damage in (False, True):
        want = _in_order(_report(r[0], r[1], damage) for r in rows)
        assert _in_order(periodic_runs.run_report(df, damage=damage).collect()) == want
    long = periodic_runs.detect_runs(odd(spark).where("doc_id = 6")).first()
    assert [tuple(r) for r in long["runs"]] == [(0, 60_000, 1)] and long["collapsed"] == "word"
    assert periodic_runs.run_report(none(spark), damage=True).count() == 0


def test_runs_at_batch_ends(spark, monkeypatch):
    texts = [f"{'a b c ' * 9}" for _ in range(20)]
    got = periodic_runs._grouped
    import pyarrow as pa
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 60)
    batch = pa.RecordBatch.from_pydict({"key": list(range(20)), "text": pa.array([t.encode() for t in texts], pa.binary())})
    groups = list(got(batch, False))
    assert len(groups) == 7 and [k for keys, _ in groups for k in keys] == list(range(20))
    assert all(periodic_runs.runs_of(words) == [[(0, 27, 3)]] * len(words) for _, words in groups)
