"""Near-duplicate classes by Order MinHash and banded alignment.

A text is its words: lower-cased runs of ASCII letters, digits and non-ASCII characters. Its k-mers are runs of ``K``
words (a shorter text is one k-mer), each labelled with how often it occurred before. For each of ``SKETCHES`` hash
functions the ``ELL`` labelled k-mers of least hash, in text order, make one sketch; two texts that share a sketch are
candidates. A pair is linked if an alignment of their words matches L of them with L / (n1 + n2 - L) >= 0.8: the
order counts, so the same passages in another order do not make a near copy, and each edited word costs one match only.

If c of the u labelled k-mers of a pair are in both texts, in the same order, one sketch agrees with probability
C(c, ELL) / C(u, ELL). Where a share e of the words of a long text is replaced at random, s = (1 - e) ** K of its k-mers are
left and c / u is s / (2 - s): all sketches miss with less than 1e-4 for 5 %, 0.7 % for 8 % and 4.7 % for 10 % (similarity
0.82). Texts of at most ``SHORT`` k-mers have ``SHORT_SKETCHES`` sketches of ``SHORT_ELL`` k-mers more. Texts that have no
``SHORT_ELL`` k-mers in common, such as ten words of which a middle one differs, are no candidates.

Texts with equal words are one node. Candidates of a bucket are compared inside one task without being listed as pairs;
a task skips pairs that are already connected and emits only links that connect. Each text goes to the largest of its buckets
first: a cluster that shares many sketches is so moved and linked once, not once for each sketch. Buckets above ``BLOCK`` texts
are split into blocks that are compared in themselves and with a few common texts. Large buckets whose texts are still of several
components are bridged by a few texts of each. Then words are sent to all buckets whose texts are not all connected: of a large one
all that is still apart from its largest component is compared with every block; a component that is the largest of many buckets
with much the same texts is moved once for all of them. Blocks are bounded in texts and in bytes of packed
words, so long texts make more of them. No bucket is capped.

Null texts are copies of nothing; texts without words are copies of equal texts only; equal rows share a class. The class
id is the smallest doc_id of the class. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.batches import free_names, map_batches
from shardloom.llm.components import components
from shardloom.session import materialize

K = 5
ELL = 3
SKETCHES = 40
# Texts of at most so many k-mers have further sketches of fewer k-mers.
SHORT = 40
SHORT_ELL = 2
SHORT_SKETCHES = 24
SIMILARITY = 0.8
# Largest number of texts compared with each other in one task; larger buckets are dealt into blocks of about this many.
BLOCK = 128
# Blocks are so many times wider where few texts of a bucket are left to meet all others: each is then sent fewer times.
WIDER = 4
# Bytes of packed words that a task holds for one block, about; blocks of long texts have fewer texts.
BLOCK_BYTES = 32 << 20
# Bytes of prepared texts that a task keeps; beyond it they are prepared anew.
PREPARED_BYTES = 64 << 20
# Up to so many node numbers (8 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
# Texts of a large bucket that every block of it is compared with, and of each component in it that bridge it to the largest one.
HUBS = 4

_BLANKED = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_U = np.uint64


def words_of(raw: bytes) -> list[bytes]:
    return raw.decode("utf-8", "replace").lower().encode("utf-8").translate(_BLANKED).split()


class _WordHashes(dict):
    """24-bit hashes of words, remembered; a k-mer of five words still has 120 bits, and two words agree by chance in 6e-8."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word) & 0xFFFFFF
        return value


_HASHES = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint32, len(words))


def pack_words(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def unpack_words(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def kmers(hashes: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """K-mers in text order, plain and occurrence-labelled; the labelled ones are all different."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    words = _mix(hashes.astype(np.uint64) + _U(1))
    count = max(1, len(words) - k + 1)
    value = np.zeros(count, np.uint64)
    for j in range(min(k, len(words))):
        value = value * _U(0x9E3779B97F4A7C15) + words[j : j + count]
    value = _mix(value)
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    nth = np.arange(count) - np.maximum.accumulate(np.where(new, np.arange(count), 0))
    label = np.empty(count, np.uint64)
    label[order] = nth
    return value, np.where(label == 0, value, _mix(value + label * _U(0xD1B54A32D192ED03)))


_SEEDS = _mix(np.arange(1, 1 + 256, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def sketches(mers: np.ndarray, count: int = SKETCHES, ell: int = ELL, skip: int = 0) -> list[int]:
    """One signed 64-bit value for each hash function after the first ``skip``: its ``ell`` least k-mers, hashed in text order.

    The low byte is the number of the hash function, so one value names a bucket; two others agree by chance in 2**-56.
    """
    if not len(mers):
        return []
    take = min(ell, len(mers))
    out: list[int] = []
    together = max(1, (1 << 17) // len(mers))  # hash functions computed in one go
    for first in range(0, count, together):
        value = (mers[None, :] ^ _SEEDS[skip + first : skip + min(first + together, count), None]) * _U(0xBF58476D1CE4E5B9)
        value ^= value >> _U(29)
        value *= _U(0x94D049BB133111EB)
        chosen = mers[np.sort(np.argpartition(value, take - 1, axis=1)[:, :take], axis=1)]
        total = np.full(len(chosen), take, np.uint64)
        for place in range(take):
            total = _mix(total * _U(0x9E3779B97F4A7C15) + chosen[:, place])
        number = np.arange(skip + first, skip + first + len(total), dtype=np.uint64)
        out += ((total & ~_U(255)) | number).view(np.int64).tolist()
    return out


def all_sketches(mers: np.ndarray) -> list[int]:
    """The sketches of a text, with the further ones of a short text behind those that all texts have."""
    return sketches(mers) + (sketches(mers, SHORT_SKETCHES, SHORT_ELL, SKETCHES) if len(mers) <= SHORT else [])


# --- comparison ------------------------------------------------------------------------------------------------------


def banded_lcs(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence among alignments that stay within ``band`` of the diagonal."""
    width = 2 * band + 1
    shape = np.full(len(a) + width + len(b), 2**64 - 1, np.uint64)
    shape[band : band + len(b)] = b
    row = np.zeros(width + 1, np.int64)  # row[d]: column i - band + d of the row before
    for i, value in enumerate(a):
        equal = shape[i : i + width] == value
        # Column j of this row lies one place further left than in the row before.
        row[:-1] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + equal))
        row[-1] = row[-2]
    return int(row.max())


class Text:
    """Words of one text, plain in order, and labelled by occurrence and sorted for intersection."""

    __slots__ = ("plain", "size", "ranked", "order", "repeats")

    def __init__(self, packed: bytes):
        self.plain, mers = kmers(unpack_words(packed), 1)
        self.size = len(mers)
        self.order = np.argsort(mers)
        self.ranked = mers[self.order]
        self.repeats = bool((self.plain != mers).any())


def _rising(places: np.ndarray) -> int:
    """Length of the longest rising subsequence."""
    if (np.diff(places) > 0).all():
        return len(places)
    ends: list[int] = []
    for place in places.tolist():
        at = bisect_left(ends, place)
        ends[at : at + 1] = [place]
    return len(ends)


def _matches(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray | None:
    """Places in ``b`` of each value of ``a`` in turn, the last place first; None if they are more than ``most``.

    A rising subsequence takes at most one place for each value of ``a``, so the longest is the full alignment.
    """
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    first, end = np.searchsorted(ranked, a), np.searchsorted(ranked, a, "right")
    count = end - first
    if (total := int(count.sum())) > most:
        return None
    within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    return order[np.repeat(end, count) - 1 - within]


def alike(x: Text, y: Text, least: float = SIMILARITY) -> bool:
    """Whether an alignment matches enough words.

    The common labelled words bound the matches from above, those in rising order from below. Where neither text repeats
    a word the second bound is exact. Otherwise, between the bounds, the plain sequences are aligned in full: over the
    places with equal k-mers where these are few, else within the band that a sufficient alignment cannot leave.
    """
    n, m = x.size, y.size
    if not n or not m or min(n, m) < least * max(n, m):
        return False
    need = least / (1 + least) * (n + m) - 1e-9
    at = np.searchsorted(y.ranked, x.ranked)
    at[at == m] = m - 1
    common = y.ranked[at] == x.ranked
    if int(common.sum()) < need:
        return False
    here, there = x.order[common], y.order[at[common]]
    if _rising(there[np.argsort(here)]) >= need:
        return True
    if not (x.repeats or y.repeats):
        return False
    matches = _matches(x.plain, y.plain, 16 * (n + m))
    if matches is not None:
        return _rising(matches) >= need
    return banded_lcs(x.plain, y.plain, int((n + m) * (1 - least) / (1 + least)) + 1) >= need


# --- jobs ------------------------------------------------------------------------------------------------------------


def row_print(text: str) -> Column:
    """What tells rows of one doc_id apart: two checksums of the text."""
    return F.struct(F.xxhash64(F.col(f"`{text}`")).alias("x"), F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(-1)).alias("c"))


def sketch_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document, written: at, doc_id, print, text_key (null for null texts), sketch, words."""
    rows = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"), row_print(text).alias("print"), F.col(f"`{text}`").alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks, packed = [], [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(raw or b"")
                hashes = word_hashes(words)
                same = b"w" + b" ".join(words) if words else b"t" + (raw or b"")
                keys.append(None if raw is None else hashlib.md5(same).digest())
                marks.append(all_sketches(kmers(hashes)[1]))
                packed.append(pack_words(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("print"), pa.array(keys, pa.binary()),
                 pa.array(marks, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                ["doc_id", "print", "text_key", "sketch", "words"],
            )

    made = map_batches(
        rows, step, "doc_id bigint, print struct<x: bigint, c: bigint>, text_key binary, sketch array<bigint>, words binary")
    return materialize(made.withColumn("at", F.monotonically_increasing_id()), "sketched")


def _few(df: DataFrame) -> DataFrame:
    """A written table of node numbers or sketch values, to be sent to all tasks if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def _buckets(nodes: DataFrame) -> DataFrame:
    """(value, node, bytes, j, n, total bytes) for each bucket of at least two texts.

    The many values that only one text has are told by a count of bare values; what follows reads the others alone.
    Buckets with the same texts are one: the first of them is kept, which is also the first that its pairs share.
    """
    spread = nodes.select("node", "bytes", F.explode("sketch").alias("value"))
    shared = materialize(spread.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value"), "shared")
    members = materialize(spread.join(_few(shared), "value"), "members")
    sizes = members.groupBy("value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"),
        F.bit_xor(F.xxhash64("node")).alias("f"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g"))
    j = F.col("value").bitwiseAND(255).cast("int")
    kept = materialize(
        sizes.groupBy("n", "total", "f", "g").agg(F.min(F.struct(j.alias("j"), "value")).alias("b")).select("b.*", "n", "total"), "kept")
    return members.join(_few(kept), "value")


class _Group:
    """Texts of one bucket or of two blocks of it; compares what is not yet connected and yields the links."""

    def __init__(self, rows: list[tuple], least: float):
        # rows: node, role, label, sketch, words
        seen: dict[tuple[int, int], int] = {}
        self.rows = [r for k, r in enumerate(rows) if seen.setdefault((r[0], r[1]), k) == k]
        self.root = {r[2]: r[2] for r in self.rows}
        self.texts: dict[int, Text] = {}
        self.prepared = 0
        # Short texts have more sketches than others; all members of a bucket have those up to its own. What fills the rows of
        # the others is no sketch, and not the same for two roles.
        most = max(len(r[3]) for r in self.rows)
        self.marks = np.array([list(r[3]) + [-1 - r[1]] * (most - len(r[3])) for r in self.rows], np.int64)
        self.least = least

    def _find(self, label: int) -> int:
        while self.root[label] != label:
            self.root[label] = label = self.root[self.root[label]]
        return label

    def _text(self, k: int) -> Text:
        node = self.rows[k][0]
        text = self.texts.get(node)
        if text is None:
            if self.prepared > PREPARED_BYTES:
                self.texts.clear()
                self.prepared = 0
            text = self.texts[node] = Text(self.rows[k][4])
            self.prepared += 24 * text.size
        return text

    def links(self, j: int) -> Iterator[tuple[int, int]]:
        """Members (role 0) are compared with hubs (role 1) first, then with each other; others (role 2) with members only.

        With ``j`` below 0 the group is of several buckets, and pairs that share a sketch are compared.
        """
        role = np.array([r[1] for r in self.rows])
        members = np.flatnonzero(role == 0)
        for firsts, seconds in ((np.flatnonzero(role == 1), members), (np.flatnonzero(role == 2), members),
                                (members if not (role == 2).any() else members[:0], members)):
            for x in firsts:
                others = seconds[seconds > x] if role[x] == 0 else seconds
                if j < 0:
                    others = others[(self.marks[others] == self.marks[x]).any(axis=1)]
                elif j > 0:
                    # A pair is compared in the first bucket that it shares.
                    others = others[~(self.marks[others, :j] == self.marks[x, :j]).any(axis=1)]
                for y in others:
                    a, b = self._find(self.rows[x][2]), self._find(self.rows[y][2])
                    if a != b and alike(self._text(x), self._text(y), self.least):
                        self.root[max(a, b)] = min(a, b)
                        yield self.rows[x][0], self.rows[y][0]


def _linked(placed: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Links inside each group of ``placed`` (node, j, group, role, label); groups are bounded in rows and bytes."""
    rows = placed.join(words, "node").select("group", "node", "role", "label", "sketch", "words", "j")
    dealt = rows.repartition("group").sortWithinPartitions("group")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: str | None = None
        held: list[tuple] = []
        j = 0

        def flush() -> pa.RecordBatch:
            u, v = zip(*pairs) if (pairs := list(_Group(held, least).links(j))) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for g, *row, which in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if held and g != group:
                    yield flush()
                    held = []
                group, j = g, which
                held.append(tuple(row))
        if held:
            yield flush()

    return map_batches(dealt, step, "u bigint, v bigint")


def _dealt(seed: int, parts: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(parts))


def _each(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))


def _placed(df: DataFrame, role: int) -> DataFrame:
    """Rows with the name of their group: bucket, share and block."""
    return df.select("node", "j", F.concat_ws(":", "j", "value", "share", "block").alias("group"), F.lit(role).alias("role"), "label")


def _parts(count: str, size: str, block: int, block_bytes: int) -> Column:
    """Number of blocks for so many texts of so many bytes."""
    return F.ceil(F.greatest(F.col(count) / block, F.col(size) / block_bytes)).cast("bigint")


def near_links(nodes: DataFrame, words: DataFrame, least: float = SIMILARITY, block: int = BLOCK,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (u, v) between nodes that together connect every candidate pair that is alike: each node with its root."""
    roots = near_roots(nodes, words, least, block, block_bytes)
    return roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def near_roots(nodes: DataFrame, words: DataFrame, least: float = SIMILARITY, block: int = BLOCK,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(node, root), written, for every node with a candidate; roots are equal where candidate pairs that are alike connect.

    First each text is compared in the largest of its buckets only. Then large buckets whose texts are still apart are bridged
    by a few texts of each component. Last, pairs in buckets whose texts are apart are compared, wherever they share one, so the
    steps before save rows and decide nothing. Links after the first step are between components, of which few are left.
    """
    if "bytes" not in nodes.columns:
        nodes = nodes.join(words.select("node", F.octet_length("words").alias("bytes")), "node")
    buckets = materialize(_buckets(nodes), "buckets")
    home = materialize(
        buckets.groupBy("node").agg(F.max(F.struct("n", "value", "bytes", "total")).alias("b")).select("node", "b.*"), "home")
    # All comparisons read the words of these texts and of no others.
    words = materialize(words.join(_few(home.select("node")), "node", "left_semi"), "words")
    placed = home.withColumns({"j": F.lit(0), "label": F.col("node"), "parts": _parts("n", "total", block, block_bytes)})
    found = materialize(_linked(_in_blocks(placed, _hubs(placed.where("parts > 1"))), words, least), "links")
    linked = components(found)
    roots = materialize(home.select("node").join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    labelled = materialize(
        buckets.join(linked.withColumnRenamed("root", "label"), "node", "left")
        .withColumns({"label": F.coalesce("label", "node"), "parts": _parts("n", "total", block, block_bytes)}), "labelled")
    left = materialize(_apart(labelled), "left")
    if not left.where("parts > 1").isEmpty():
        found = materialize(_linked(_bridges(left.where("parts > 1"), block, block_bytes), words, least), "links")
        roots, more = _merged(roots, found)
        left = materialize(left.join(more, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"), "labelled")
        left = materialize(_apart(left), "left")
    found = materialize(_linked(_rest(left, block, block_bytes), words, least), "links")
    return _merged(roots, found)[0]


def _apart(labelled: DataFrame) -> DataFrame:
    """Rows of the buckets whose texts are of several components."""
    apart = labelled.groupBy("value").agg((F.min("label") < F.max("label")).alias("apart")).where("apart").select("value")
    return labelled.join(_few(materialize(apart, "apart")), "value")


def _merged(roots: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``roots`` after more ``links`` between its nodes, written, and (label, to) for the components that these links connect."""
    sent = F.broadcast if links.count() <= BROADCAST_NODES else lambda df: df
    ends = links
    for end in ("u", "v"):
        ends = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")).join(sent(ends), end)
    more = _few(components(ends.select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))).toDF("label", "to"))
    merged = roots.withColumnRenamed("root", "label").join(more, "label", "left").select("node", F.coalesce("to", "label").alias("root"))
    return materialize(merged, "roots"), more


def _picked() -> list[Column]:
    """Aggregates h0, h1, ...: texts of a group in the order of several hashes."""
    return [F.min(F.struct(F.xxhash64("node", F.lit(10 + s)).alias("hash"), "node", "label")).alias(f"h{s}") for s in range(HUBS)]


def _each_picked() -> Column:
    return F.explode(F.array_distinct(F.array([F.struct(f"h{s}.node", f"h{s}.label") for s in range(HUBS)])))


def _hubs(large: DataFrame) -> DataFrame:
    """Texts that every block of a large bucket is compared with."""
    hubs = large.groupBy("j", "value", "parts").agg(*_picked()).withColumn("hub", _each_picked())
    return hubs.select("j", "value", "parts", "hub.node", "hub.label")


def _in_blocks(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """``members`` of buckets in blocks, each with all ``hubs`` of its bucket."""
    share = F.lit(0).cast("bigint")
    members = members.withColumns({"share": share, "block": _dealt(2, "parts")})
    return _placed(members, 0).union(_placed(hubs.withColumns({"share": share, "block": _each("parts")}), 1))


def _main(large: DataFrame) -> DataFrame:
    """(value, main, apart, apart_bytes): the largest component of each bucket and how much is apart from it."""
    counts = large.groupBy("value", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("b"))
    return counts.groupBy("value").agg(
        F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("apart"),
        (F.sum("b") - F.max_by("b", F.struct("c", "label"))).alias("apart_bytes")).where("apart > 0")


def _bridges(large: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """A few texts of each component of a bucket in blocks, with a few of the bucket's largest component in each."""
    some = large.groupBy("value", "label").agg(*_picked()).join(_main(large), "value").withColumns({
        "hub": _each_picked(), "parts": _parts("apart", "apart_bytes", block, block_bytes), "j": F.lit(0)})
    some = materialize(some.select("j", "value", "parts", "main", "hub.node", "hub.label"), "bridges")
    return _in_blocks(some.where("label <> main"), some.where("label = main"))


def _rest(left: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Groups in which all pairs of a bucket meet, but for those within the largest component of a large one.

    Buckets of the same largest component may share most of their texts. Where that takes fewer rows, the component's texts
    stand once for all its buckets, and what is apart from it in any of them meets them there.
    """
    zero, other = F.lit(0).cast("bigint"), F.col("label") != F.col("main")
    small = _placed(left.where("parts = 1").withColumns({"share": zero, "block": zero}), 0)
    large = left.where("parts > 1")
    large = materialize(large.join(_main(large), "value").withColumns({
        "shares": _parts("apart", "apart_bytes", WIDER * block, block_bytes), "parts": _parts("n", "total", WIDER * block, block_bytes)}), "large")
    met = materialize(large.groupBy("main", "node").agg(
        F.max("label").alias("label"), F.max("bytes").alias("bytes"), F.sum(F.col("shares") + F.when(other, F.col("parts")).otherwise(0)).alias("each"),
        F.sum(F.when(other, 2 * F.col("shares")).otherwise(0)).alias("others")), "met")
    sums = met.groupBy("main").agg(F.sum("each").alias("each"), F.sum("others").alias("others"), *(
        F.sum(F.when(which, of).otherwise(0)).alias(name) for name, which, of in (
            ("n", ~other, F.lit(1)), ("total", ~other, F.col("bytes")), ("apart", other, F.lit(1)), ("apart_bytes", other, F.col("bytes")))))
    sums = sums.select("main", "n", "apart", "each", "others", _parts("n", "total", WIDER * block, block_bytes).alias("blocks"),
                       _parts("apart", "apart_bytes", WIDER * block, block_bytes).alias("visits"))
    once = _few(materialize(sums.where("n * visits + apart * blocks + others < each").select("main", "blocks", "visits"), "once"))
    large = large.join(once, "main", "left")
    each = large.where("blocks IS NULL").withColumn("block", _dealt(7, "parts"))
    among = large.where("blocks IS NOT NULL").where(other).withColumn("block", _dealt(7, "shares"))
    met = met.join(once, "main").withColumns({"j": F.lit(-1), "value": F.col("main")})
    groups = [
        _placed(each.withColumn("share", _each("shares")), 0),
        _placed(each.where(other).withColumns({"share": _dealt(5, "shares"), "block": _each("parts")}), 2),
        _placed(among.withColumn("share", _each("shares")), 0),
        _placed(among.where("shares > 1").withColumns({"share": _dealt(5, "shares"), "block": _each("shares")}), 2),
        _placed(met.where(~other).withColumns({"share": _each("visits"), "block": _dealt(7, "blocks")}), 0),
        _placed(met.where(other).withColumns({"share": _dealt(5, "visits"), "block": _each("blocks")}), 2),
    ]
    return reduce(DataFrame.union, groups, small)


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row for each document: doc_id, print, class_id (smallest doc_id of its class), class_size, first (of its class)."""
    base = sketch_texts(docs, text, key)
    # A null text is a node of its own; equal texts are one node, named by its first row.
    same = F.coalesce("text_key", F.encode(F.concat(F.lit("row "), F.col("at").cast("string")), "utf-8"))
    keyed = base.withColumn("same", same)
    named = materialize(keyed.groupBy("same").agg(F.min("at").alias("node")), "named")
    words = base.where(F.size("sketch") > 0).select(F.col("at").alias("node"), "sketch", "words")
    nodes = materialize(words.select("node", "sketch", F.octet_length("words").alias("bytes"))
                        .join(_few(named.select("node")), "node", "left_semi"), "nodes")
    roots = _few(near_roots(nodes, words, least).where("node <> root"))
    rooted = named.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    rows = keyed.select("same", "doc_id", "print", "at").join(rooted, "same")
    heads = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(
        F.col("doc_id").isNull(), "doc_id", "print", "at")).alias("head"))
    return rows.join(heads, "root").select("doc_id", "print", "class_id", "class_size", (F.col("at") == F.col("head.at")).alias("first"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id; columns as before."""
    def identity(doc_id: Column, mark: Column) -> Column:
        return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), mark.alias("print"))

    row, first, several = free_names(docs, "row", "first", "several")
    found = classes(docs, text, key, least).select(identity(F.col("doc_id"), F.col("print")).alias(row), "first")
    # Rows alike in doc_id and text are one document; they are rare, and only they are looked at again.
    kept = materialize(found.groupBy(row).agg(F.max("first").alias(first), (F.count(F.lit(1)) > 1).alias(several)).where(F.col(first)), "kept")
    named = docs.withColumn(row, identity(F.col(f"`{key}`").cast("bigint"), row_print(text)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = named.join(kept.where(~F.col(several)).select(row), row, "left_semi").select(columns)
    again = kept.where(several)
    if again.isEmpty():
        return out
    return out.union(named.join(again.select(row), row, "left_semi").dropDuplicates([row]).select(columns))
