"""Cheapest repair of the structure of conversations, by Four-Russians block tables.

A repaired conversation has role initials ``(s?(ua)+)?``: nothing, or turns of user and assistant by pairs, perhaps behind one
system row. Each row may be kept (cost 0, if its initial may follow), rerolled to user or assistant (3) or deleted (4; the only
way for blank and repeated rows), and empty rows of user or assistant may be inserted anywhere (3). A truncated row that is not
deleted adds 3. Of the cheapest edit sequences the one whose initials (D, I, K, R) are least in ASCII order is taken.

A row counts by one of ``SYMBOLS``. The cost to the end from each of the four states of the pattern is a vector; less its
minimum it is one of few. For every such vector and every block of ``BLOCK`` symbols a table holds the vector before the block
and what the minimum grows by. A conversation is read backward, one lookup for each block, and traced forward: each block is
expanded backward again from the vector behind it and the least edit that keeps the cost is taken, so ties are decided by the
whole rest. Traces of a block from the same vector and state are remembered.

In Spark, rows alike in conversation, turn, role and text are one row with a number. The first turn of each text of a
conversation comes from an aggregate and a join on all four, so a conversation of any share of the rows is spread. Rows dealt
by ranges of (conversation, turn, role, text) give strings of one byte for each row, joined for each conversation: it needs no
more room than its audit does. The digest of the repaired text is sequential by nature: rows stream through it in order, none
is held but the current one.

A row without a value counts as one space there (so a null text is blank, a null role has no legal initial); null turns come
first; equal turns stand in the order of role, then of the text's MD5 sum; a null conversation is one of its own. Roles count by
their first character. An empty table gives no rows. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.batches import map_batches

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# Characters that are no content; written out because regular expressions of engines differ in \s.
_WHITE = r"\x20\x09-\x0D"

# States of the pattern: nothing yet, behind system, behind user, behind assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
# The state behind a row of user or assistant that may come next, and behind a kept initial.
_NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# Cost to the end of the text when no row is left.
_END = (0, 2 * INSERT, INSERT, 0)

# One symbol for each row: its initial and whether it is truncated, or that it must go.
SYMBOLS = tuple((initial, cut) for initial in "sua?" for cut in (False, True)) + ((None, False),)
MUST_GO = len(SYMBOLS) - 1
BLOCK = 4
_FAR = 10**6


# --- tables ---------------------------------------------------------------------------------------------------------------


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a row of this symbol, from those behind it."""
    initial, cut = SYMBOLS[symbol]
    extra = TRUNCATED * cut
    costs = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if initial is not None:
            ways.append(REROLE + extra + after[_NEXT[state]])
            ways.append(extra + after[_KEPT[state, initial]] if (state, initial) in _KEPT else _FAR)
        costs.append(min(ways))
    for _ in range(3):  # inserted rows in front, at most once around
        costs = [min(c, INSERT + costs[_NEXT[state]]) for state, c in enumerate(costs)]
    return tuple(costs)


class Tables:
    """Vectors that can occur, and for each of them and each block the vector before the block and the growth."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        known = {_END: 0}
        self.vectors = [_END]
        steps: list[list[tuple[int, int]]] = []
        while len(steps) < len(self.vectors):
            row = []
            for symbol in range(len(SYMBOLS)):
                costs = _before(symbol, self.vectors[len(steps)])
                least = min(costs)
                plain = tuple(c - least for c in costs)
                if plain not in known:
                    known[plain] = len(self.vectors)
                    self.vectors.append(plain)
                row.append((known[plain], least))
            steps.append(row)
        #: step[vector, symbol] and growth[vector, symbol] for single rows, jump and rise for whole blocks.
        self.step = np.array([[v for v, _ in row] for row in steps], np.int32)
        self.growth = np.array([[g for _, g in row] for row in steps], np.int32)
        jump, rise = self.step, self.growth
        for _ in range(block - 1):
            # One more symbol behind the block: it is met first.
            jump, rise = (np.concatenate(parts, axis=1) for parts in zip(*(self._behind(jump, rise, s) for s in range(len(SYMBOLS)))))
        self.jump, self.rise = jump.tolist(), rise.tolist()
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _behind(self, jump: np.ndarray, rise: np.ndarray, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        middle = self.step[:, symbol]
        return jump[middle], rise[middle] + self.growth[:, symbol][:, None]

    def code(self, symbols: bytes) -> int:
        """The number of a block; the last symbol counts most."""
        value = 0
        for symbol in reversed(symbols):
            value = value * len(SYMBOLS) + symbol
        return value

    def trace(self, symbols: bytes, behind: int, state: int) -> tuple[str, int]:
        """Edits of these rows from ``state`` when the vector behind them is ``behind``, and the state they end in."""
        costs = [self.vectors[behind]]
        for symbol in reversed(symbols):
            costs.append(_before(symbol, costs[-1]))
        costs.reverse()
        out = []
        for i, symbol in enumerate(symbols):
            here, after = costs[i], costs[i + 1]
            initial, cut = SYMBOLS[symbol]
            extra = TRUNCATED * cut
            while True:  # D, I, K, R: the least that keeps the cost
                if here[state] == DELETE + after[state]:
                    out.append("D")
                elif here[state] == INSERT + here[_NEXT[state]]:
                    out.append("I")
                    state = _NEXT[state]
                    continue
                elif (state, initial) in _KEPT and here[state] == extra + after[_KEPT[state, initial]]:
                    out.append("K")
                    state = _KEPT[state, initial]
                else:
                    out.append("R")
                    state = _NEXT[state]
                break
        return "".join(out), state

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Least cost and its audit for a conversation of these symbols."""
        size = self.block
        # Blocks end where the conversation does; what is left in front is shorter than a block.
        cuts = range(len(symbols) % size, len(symbols), size)
        codes = [self.code(symbols[c : c + size]) for c in cuts]
        vector, cost = 0, 0
        behind = []
        for code in reversed(codes):
            behind.append(vector)
            cost += self.rise[vector][code]
            vector = self.jump[vector][code]
        head = symbols[: len(symbols) % size]
        left = vector
        for symbol in reversed(head):
            cost += int(self.growth[left, symbol])
            left = int(self.step[left, symbol])
        audit, state = self.trace(head, vector, START)
        pieces = [audit]
        for at, code, after in zip(cuts, codes, reversed(behind)):
            known = self.traces.get((code, after, state))
            if known is None:
                known = self.traces[code, after, state] = self.trace(symbols[at : at + size], after, state)
            pieces.append(known[0])
            state = known[1]
        while _END[state]:
            pieces.append("I")
            state = _NEXT[state]
        return cost + self.vectors[left][START], "".join(pieces)


@cache
def tables() -> Tables:
    return Tables()


# --- rows -----------------------------------------------------------------------------------------------------------------


def _spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def read_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and dropped (false), nulls of role and text as one space."""
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
                       _spaced(F.col(f"`{role}`")).alias("role"), _spaced(F.col(f"`{text}`")).alias("text"), F.lit(False).alias("dropped"))


def damage_rows(rows: DataFrame) -> DataFrame:
    """Rows of :func:`read_rows` with faults by checksum of conversation and turn, to test repairs.

    Of twenty cases: dropped, emptied, without marks of ends, repeated, rerolled to user, else unchanged.
    """
    case = F.crc32(F.concat_ws(":", _spaced(F.col("conv")), _spaced(F.col("turn"))).cast("binary")) % 20
    hurt = rows.withColumn("case", case).select(
        "conv", "turn",
        F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("case") == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("case") == 3, 2).otherwise(1))).alias("copy"))
    return hurt.drop("copy")


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def symbol_rows(rows: DataFrame) -> DataFrame:
    """Different rows of each conversation: conv, turn, role, digest, initial, n (how often), fault of the first (b, d, t or -), again (fault of the others)."""
    last = F.regexp_extract("text", rf"([^{_WHITE}])[{_WHITE}]*$", 1)
    blank = ~F.col("text").rlike(rf"[^{_WHITE}]")
    seen = rows.select(
        "conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "dropped",
        F.when(blank, F.lit("b")).when(last.isin(".", "!", "?"), F.lit("-")).otherwise(F.lit("t")).alias("own"))
    alike = seen.groupBy("conv", "turn", "role", "digest", "dropped", "own").agg(F.count(F.lit(1)).alias("n"))
    # A struct with a null first field sorts first, as turns do.
    keys = ("conv", "turn", "role", "digest")
    firsts = alike.where(~F.col("dropped")).groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("t")).select(
        F.col("conv").alias("first_conv"), F.col("t.turn").alias("first_turn"), F.col("role").alias("first_role"),
        F.col("digest").alias("first_digest"), F.lit(True).alias("first"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in keys))
    again = F.when(F.col("own") == "b", F.lit("b")).otherwise(F.lit("d"))
    return alike.join(firsts, same, "left").select(
        *keys, "dropped", "n", F.when(F.col("first").isNotNull(), F.col("own")).otherwise(again).alias("fault"), again.alias("again"))


def _pieces(rows: DataFrame) -> DataFrame:
    """For each conversation and range of rows: initials and faults as strings, and what the turns there span."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order()).select(
        F.spark_partition_id().alias("part"), "conv", "turn",
        F.when(F.col("dropped"), "").otherwise(F.substring("role", 1, 1)).alias("initial"),
        F.when(F.col("dropped"), 0).otherwise(F.col("n")).cast("bigint").alias("n"), "fault", "again")
    conv_type = rows.schema["conv"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv: object = nothing
        held: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            if conv is nothing:
                return
            initials, faults, turns = [], [], []
            for _, turn, initial, n, fault, again in held:
                if not n:
                    continue
                initials.append((initial if initial in ("s", "u", "a") else "?") * n)
                faults.append(fault + again * (n - 1))
                if turn is not None and (not turns or turns[-1] != turn):
                    turns.append(turn)
            yield pa.RecordBatch.from_pydict({
                "conv": pa.array([conv], kind), "part": pa.array([held[0][0]], pa.int32()), "initials": ["".join(initials)],
                "faults": ["".join(faults)], "low": pa.array([turns[0] if turns else None], pa.int64()),
                "high": pa.array([turns[-1] if turns else None], pa.int64()), "turns": pa.array([len(turns)], pa.int64())})

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv").type
            for part, this, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if conv is nothing or this != conv:
                    yield from flush()
                    conv, held = this, []
                held.append((part, *row))
        yield from flush()

    return map_batches(dealt, step, f"conv {conv_type}, part int, initials string, faults string, low bigint, high bigint, turns bigint")


def repair_plans(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (:func:`read_rows`): conv, rows, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    pieces = _pieces(symbol_rows(rows))
    conv_type = rows.schema["conv"].dataType.simpleString()
    whole = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "initials", "faults", "low", "high", "turns"))).alias("p"))
    joined = whole.select("conv", F.array_join("p.initials", "").alias("initials"), F.array_join("p.faults", "").alias("faults"),
                          F.filter("p", lambda x: x["turns"] > 0).alias("p"))
    # A turn that ends one range and opens the next is one turn.
    shared = F.size(F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get(F.col("p.high"), i - 1) == F.get(F.col("p.low"), i)))
    turns = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["turns"]) - F.when(F.size("p") > 1, shared).otherwise(0)
    gaps = F.array_max("p.high") - F.array_min("p.low") + 1 - turns
    counted = joined.select("conv", F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"), "initials", "faults")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tables()
        code = {(i, f): 2 * "sua?".index(i) + (f == "t") if f in "-t" else MUST_GO for i in "sua?" for f in "-tbd"}
        for batch in batches:
            rows_out = []
            for initials, faults in zip(batch.column("initials").to_pylist(), batch.column("faults").to_pylist()):
                cost, audit = found.repair(bytes(map(code.__getitem__, zip(initials, faults))))
                legal = sum(initials.count(pair) for pair in ("su", "ua", "au"))
                rows_out.append((len(initials), faults.count("b"), faults.count("d"), faults.count("t"), max(len(initials) - 1, 0) - legal, cost, audit))
            columns = list(zip(*rows_out)) if rows_out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(columns[0], pa.int64()), batch.column("gaps"), *(pa.array(c, pa.int64()) for c in columns[1:6]),
                 pa.array(columns[6], pa.string())],
                ["conv", "rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return map_batches(counted, step, f"conv {conv_type}, rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
                                      "illegal bigint, cost bigint, audit string")


class _Replay:
    """Follows an audit over the rows of its conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _made(self) -> str:
        self.state = _NEXT[self.state]
        return "user" if self.state == USER else "assistant"

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._made(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows that come out for one that goes in."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._made(), text
        elif edit == "K":
            self.state = _KEPT[self.state, role[:1]]
            yield edit, role, text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _replayed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans and rows of each conversation in one task and in order: a plan, then its rows. Nothing is held."""
    heads = plans.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"),
                         F.lit("").alias("text"), F.struct("*").alias("plan"))
    body = rows.where(~F.col("dropped")).select(
        "conv", F.lit(1).alias("kind"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text",
        F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"))
    order = [F.asc_nulls_first("conv"), F.asc("kind"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    return heads.union(body).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "turn", "role", "text", "plan")


def repaired_rows(rows: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv, position (from 0), turn (null for inserted rows), role, text and edit (I, K or R)."""
    dealt = _replayed(rows, repair_plans(rows) if plans is None else plans).withColumn("audit", F.col("plan.audit")).drop("plan")
    conv_type = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "position", "turn", "role", "text", "edit"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, conv, position = _Replay(""), None, 0
        kind = pa.null()

        def made(found: list) -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = list(zip(*found)) if found else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            kind = batch.schema.field("conv").type
            out = []
            for this, header, turn, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if header == 0:
                    out += [(conv, position + i, None, r, t, edit) for i, (edit, r, t) in enumerate(replay.rest())]
                    replay, conv, position = _Replay(audit), this, 0
                    continue
                for edit, r, t in replay.row(role, text):
                    out.append((conv, position, None if edit == "I" else turn, r, t, edit))
                    position += 1
            yield made(out)
        yield made([(conv, position + i, None, r, t, edit) for i, (edit, r, t) in enumerate(replay.rest())])

    return map_batches(dealt, step, f"conv {conv_type}, position bigint, turn bigint, role string, text string, edit string")


def repair_digests(rows: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """The plans with repaired_sha256, the digest of the repaired rows as ``role:text`` lines."""
    plans = repair_plans(rows) if plans is None else plans
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plans.schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, digest, lines, plan = _Replay(""), hashlib.sha256(), 0, None
        kind = None

        def add(made: Iterator[tuple[str, str, str]]) -> None:
            nonlocal lines
            for _, role, text in made:
                digest.update(("\n" * (lines > 0) + role + ":" + text).encode())
                lines += 1

        def finished() -> list[dict]:
            if plan is None:
                return []
            add(replay.rest())
            return [{**plan, "repaired_sha256": digest.hexdigest()}]

        for batch in batches:
            kind = kind or pa.schema([*batch.schema.field("plan").type, pa.field("repaired_sha256", pa.string())])
            out = []
            plan_column = batch.column("plan")
            headers = batch.column("kind").to_pylist()
            for i, (header, role, text) in enumerate(zip(headers, batch.column("role").to_pylist(), batch.column("text").to_pylist())):
                if header == 0:
                    out += finished()
                    plan = plan_column[i].as_py()
                    replay, digest, lines = _Replay(plan["audit"]), hashlib.sha256(), 0
                else:
                    add(replay.row(role, text))
            yield pa.RecordBatch.from_pylist(out, kind)
        if plan is not None:
            yield pa.RecordBatch.from_pylist(finished(), kind)

    return map_batches(_replayed(rows, plans), step, f"{schema}, repaired_sha256 string")
