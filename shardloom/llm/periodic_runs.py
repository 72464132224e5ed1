"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q and at least ``max(6, 4 q)`` words that no neighbouring word extends with
that period. Words are stretches without ASCII white space. The texts of a batch are one sequence of numbered words in which
every text ends with a number of its own, so nothing reaches over an end.

Prefix doubling names all stretches of 1, 2, 4, ... words and ends in the suffix array; a name is the first place of its
stretches there, so names and their counts are intervals. A wavelet matrix over the suffix array answers range successors:
the least text position beyond x inside an interval. A run of period q holds a dyadic block (length 2**k, at a multiple of
its length) with 3/4 q < 2**k <= 3/2 q whose stretch comes again q words further on. Occurrences that start within 2**k words
of the block form one progression, so only the first distance can be a smallest period. Beyond, up to 4/3 of 2**k, another
progression may lie: its first distance is a candidate, and if it has several terms, the shift that moves the right end of the
block's own repetition onto that of the progression. Candidates are extended to both sides by the names and kept if long
enough; of equal stretches the least period stays.

Work is arrays over whole batches, about 150 bytes for each word of a batch; a batch holds some ``BATCH_WORDS`` words or one
longer text. No row moves between tasks.

A null text has no words, an empty one neither; a null id is like any other; equal rows have equal results, an empty table has
none. Only the two named columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.batches import map_batches

LEAST_WORDS = 6
LEAST_EXPONENT = 4
BATCH_WORDS = 1 << 18

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def words_of(raw: bytes) -> list[bytes]:
    """Stretches without ``\\x20`` and ``\\x09`` to ``\\x0D``; no other byte of UTF-8 text is split at."""
    return raw.split()


# --- names and suffix array --------------------------------------------------------------------------------------------


def doubled_names(values: np.ndarray) -> list[np.ndarray]:
    """``names[k][i]``: how many positions have a smaller stretch of 2**k words than position i.

    Stretches that reach beyond the end are smaller than their continuations. The last names are all different, so they
    are ranks in the suffix array. Only positions whose name is shared are sorted again in the next round.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    name = np.empty(n, np.int32)
    name[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    out = [name]
    # Positions that share their name, in the order of names.
    shared = order[~(new & np.r_[new[1:], True])]
    step = 1
    while len(shared):
        follow = np.zeros(len(shared), np.int64)
        inside = shared + step < n
        follow[inside] = name[shared[inside] + step] + 1
        key = name[shared].astype(np.int64) * (n + 1) + follow
        sort = np.argsort(key, kind="stable")
        shared, key = shared[sort], key[sort]
        at = np.arange(len(key))
        old = np.r_[True, key[1:] // (n + 1) != key[:-1] // (n + 1)]
        new = np.r_[True, key[1:] != key[:-1]]
        # A class keeps its first place; the parts of it follow by how many come before them.
        offset = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        name = name.copy()
        name[shared] += offset.astype(np.int32)
        out.append(name)
        shared = shared[~(new & np.r_[new[1:], True])]
        step *= 2
    return out


# --- range successor -----------------------------------------------------------------------------------------------------


class WaveletMatrix:
    """Numbers 0 .. n - 1 by their bits, highest first; answers for many ranges at once."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = max(1, int(n).bit_length())
        self.zeros: list[int] = []  # how many numbers have bit 0, for each level
        self.before: list[np.ndarray] = []  # before[i]: numbers with bit 0 among the first i
        current = values.astype(np.int32)
        for bit in range(self.bits - 1, -1, -1):
            zero = (current >> bit) & 1 == 0
            count = np.zeros(n + 1, np.int32)
            np.cumsum(zero, out=count[1:])
            self.before.append(count)
            self.zeros.append(int(count[-1]))
            current = np.concatenate((current[zero], current[~zero]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers of each range [lo, hi) are smaller than x."""
        total = np.zeros(len(lo), np.int32)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            count, zeros = self.before[level], self.zeros[level]
            a, b = count[lo], count[hi]
            one = (x >> bit) & 1 == 1
            total += np.where(one, b - a, 0)
            lo = np.where(one, lo - a + zeros, a)
            hi = np.where(one, hi - b + zeros, b)
        return total

    def at_rank(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number of the given rank (from 0) in each range; the rank lies inside the range."""
        found = np.zeros(len(lo), np.int32)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            count, zeros = self.before[level], self.zeros[level]
            a, b = count[lo], count[hi]
            one = rank >= b - a
            rank = np.where(one, rank - (b - a), rank)
            found |= one.astype(np.int32) << bit
            lo = np.where(one, lo - a + zeros, a)
            hi = np.where(one, hi - b + zeros, b)
        return found

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """The least number above x in each range, or ``none``."""
        smaller = self.below(lo, hi, x + 1)
        out = np.full(len(lo), none, np.int64)
        there = np.flatnonzero(smaller < hi - lo)
        out[there] = self.at_rank(lo[there], hi[there], smaller[there])
        return out


# --- extension ------------------------------------------------------------------------------------------------------------


def common_right(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal words from i and from j (i < j) on."""
    n = len(names[0])
    length = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        a, b = i + length, j + length
        inside = b < n
        same = inside.copy()
        same[inside] = names[k][a[inside]] == names[k][b[inside]]
        length += same.astype(np.int64) << k
    return length


def common_left(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal words before i and before j (i < j)."""
    length = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        a, b = i - length - (1 << k), j - length - (1 << k)
        inside = a >= 0
        same = inside.copy()
        same[inside] = names[k][a[inside]] == names[k][b[inside]]
        length += same.astype(np.int64) << k
    return length


# --- runs -----------------------------------------------------------------------------------------------------------------


def _candidates(names: list[np.ndarray], matrix: WaveletMatrix) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and distances that may start a run's period."""
    n = len(names[0])
    for k, name in enumerate(names):
        size = 1 << k
        block = np.arange(0, n, size)
        count = np.bincount(name, minlength=n)
        lo = name[block]
        many = count[lo] > 1
        block, lo = block[many], lo[many]
        if not len(block):
            break  # longer stretches are all different as well
        hi = lo + count[lo].astype(np.int32)
        reach = block + 4 * size // 3

        def next_after(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return matrix.successor(lo[rows], hi[rows], x.astype(np.int32), 2 * n)

        first = next_after(block, np.arange(len(block)))
        near = np.flatnonzero(first <= block + size)
        yield block[near], first[near] - block[near]
        # The first occurrence beyond the block's own length.
        far = first.copy()
        far[near] = next_after(np.minimum(block[near] + size, n - 1), near)
        rows = np.flatnonzero(far <= reach)
        yield block[rows], far[rows] - block[rows]
        # Where it opens a progression, right ends of both repetitions tell the distance.
        second = next_after(far[rows], rows)
        more = second <= reach[rows]
        rows, far, second = rows[more], far[rows][more], second[more]
        period = second - far
        own = block[rows] + common_right(names, block[rows], block[rows] + period)
        other = far + common_right(names, far, far + period)
        yield block[rows], other - own


def find_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run of a sequence of numbers, by start, then period."""
    none = np.zeros(0, np.int64)
    if len(values) < LEAST_WORDS:
        return none, none, none
    names = doubled_names(values)
    suffixes = np.empty(len(values), np.int32)
    suffixes[names[-1]] = np.arange(len(values), dtype=np.int32)
    found = list(_candidates(names, WaveletMatrix(suffixes)))
    place, period = (np.concatenate([f[c] for f in found]) if found else none for c in (0, 1))
    usable = (period > 0) & (place + period < len(values))
    place, period = place[usable], period[usable]
    start = place - common_left(names, place, place + period)
    end = place + period + common_right(names, place, place + period)
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * period)
    start, end, period = start[long], end[long], period[long]
    # Several periods of one stretch are multiples of the least.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, a list of words."""
    numbers: dict[bytes, int] = {}
    put = numbers.setdefault
    total = sum(map(len, texts)) + len(texts)
    values = np.empty(total, np.int64)
    begins = []
    at = 0
    for t, words in enumerate(texts):
        begins.append(at)
        values[at : at + len(words)] = [put(w, len(numbers)) for w in words]
        at += len(words)
        values[at] = -1 - t  # an end like no other
        at += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    start, end, period = find_runs(values)
    owner = np.searchsorted(np.array(begins), start, "right") - 1 if len(start) else start
    for t, s, e, q in zip(owner.tolist(), start.tolist(), end.tolist(), period.tolist()):
        out[t].append((s - begins[t], e - s, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


# --- jobs -----------------------------------------------------------------------------------------------------------------


def looped_tail(key: int | None, words: list[bytes]) -> list[bytes]:
    """One text in ten, by the checksum of its id, with a tail that repeats one stretch; a null id changes nothing."""
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


def _grouped(batch: pa.RecordBatch, damage: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of the rows of a batch, so many at a time that they hold about ``BATCH_WORDS`` words."""
    keys: list = []
    texts: list[list[bytes]] = []
    held = 0
    for key, raw in zip(batch.column("key").to_pylist(), batch.column("text")):
        words = words_of(raw.as_buffer().to_pybytes()) if raw.is_valid else []
        keys.append(key)
        texts.append(looped_tail(key, words) if damage else words)
        held += len(words) + 1
        if held >= BATCH_WORDS:
            yield keys, texts
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def detect_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", damage: bool = False) -> DataFrame:
    """One row for each text: doc_id, runs (by start, then period) and collapsed, the text without repeated periods.

    ``damage`` first gives one text in ten a repeating tail (:func:`looped_tail`), to test what is found.
    """
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _grouped(batch, damage):
                runs = runs_of(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), run)) for run in found] for found in runs], kind),
                     pa.array([b" ".join(collapsed(w, found)) for w, found in zip(texts, runs)], pa.binary()).cast(pa.string())],
                    ["doc_id", "runs", "collapsed"],
                )

    return map_batches(rows, step, f"doc_id bigint, runs {RUNS}, collapsed string")


def run_report(docs: DataFrame, text: str = "text", key: str = "doc_id", damage: bool = False) -> DataFrame:
    """One row for each text: the number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    found = detect_runs(docs, text, key, damage)

    # Greater is better: an exact comparison of length / period by cross products, then the smaller start and period.
    def better(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(left != right, F.when(left > right, -1).otherwise(1)).when(
            a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(
            F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    best = F.get(F.array_sort("runs", better), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
