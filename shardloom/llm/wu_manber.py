"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lowered. The patterns are the windows of
``WINDOW`` consecutive words of each benchmark item; an item with fewer words, but not none, is one pattern. For each
pattern length there is a shift table over blocks of two words (one word for patterns of one word), buckets of patterns
by their last block, and a direct comparison of the words in the bucket.

A null or empty text has no words and no hits; items without words give no pattern; equal items and repeated windows
each count; a null item id counts as an empty one; texts are searched whole, as bytes, so broken UTF-8 does no harm. Columns named like the results are replaced, others are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.batches import map_batches, without

WINDOW = 10
# Patterns go to the tasks in shares of about this many bytes; each share is one pass over the texts, row by row.
SHARE_BYTES = 32 << 20

# A-Z become a-z; other ASCII characters that are no letter or digit become blanks; bytes of other characters stay.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WordPatterns:
    """Patterns of one length: block shift table, suffix buckets, and the items that hold each pattern."""

    def __init__(self, length: int, items: dict[tuple[bytes, ...], list]):
        self.length, self.items = length, items
        self.block = min(2, length)
        self.longest_shift = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for pattern in items:
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                left = length - end
                if self.shift.get(block, self.longest_shift) > left:
                    self.shift[block] = left
            self.bucket[pattern[length - self.block :]].append(pattern)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Each occurrence as (first word, pattern)."""
        shift, bucket, length = self.shift, self.bucket, self.length
        longest, count, pair = self.longest_shift, len(words), self.block == 2
        end = length
        while end <= count:
            block = (words[end - 2], words[end - 1]) if pair else (words[end - 1],)
            step = shift.get(block, longest)
            if step:
                end += step
                continue
            first = end - length
            head = words[first]
            for pattern in bucket[block]:
                if pattern[0] == head and tuple(words[first:end]) == pattern:
                    yield first, pattern
            end += 1


def build_patterns(items: list[tuple[object, str | None]], size: int = WINDOW) -> list[WordPatterns]:
    by_length: dict[int, dict[tuple[bytes, ...], list]] = defaultdict(dict)
    for item, text in items:
        for window in windows_of(words_of(text), size):
            holders = by_length[len(window)].setdefault(window, [])
            if not holders or holders[-1] != item:
                holders.append(item)
    return [WordPatterns(length, patterns) for length, patterns in sorted(by_length.items())]


def merged_spans(spans: list[list[int]]) -> list[list[int]]:
    """Spans ``[first, end)`` sorted, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def shares_of(benchmark: DataFrame, item: str, text: str, share_bytes: int) -> Iterator[list[tuple]]:
    """The items in lists of bounded bytes; a single larger item is a share of its own."""
    share: list[tuple] = []
    held = 0
    for row in benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")), f"`{text}`").toLocalIterator():
        cost = WINDOW * len(row[1] or "")
        if share and held + cost > share_bytes:
            yield share
            share, held = [], 0
        share.append(tuple(row))
        held += cost
    yield share


def find_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = WINDOW, share_bytes: int = SHARE_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges inside occurrences, joined) and ``hit_items`` (sorted texts of item ids).

    The search is row-local: no document moves. A benchmark beyond one share is searched in as many passes, each of
    which adds its hits to the row.
    """
    out = without(docs, ["n_words", "hit_spans", "hit_items"]).withColumns({
        "n_words": F.lit(None).cast("bigint"), "hit_spans": F.array().cast("array<array<bigint>>"),
        "hit_items": F.array().cast("array<string>"),
    })
    for share in shares_of(benchmark, item, item_text, share_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(share)
        out = map_batches(out, _searcher(sent, text, size), out.schema)
    return out


def _searcher(sent: Broadcast, text: str, size: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = build_patterns(sent.value, size)
        for batch in batches:
            counts, spans, items = [], [], []
            for value, had_spans, had_items in zip(
                batch.column(text).cast(pa.binary()).to_pylist(), batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
            ):
                words = words_of(value)
                found, holders = list(had_spans), set(had_items)
                for patterns in tables:
                    for first, pattern in patterns.search(words):
                        found.append([first, first + patterns.length])
                        holders.update(patterns.items[pattern])
                counts.append(len(words))
                spans.append(merged_spans(found))
                items.append(sorted(holders))
            columns = {**dict(zip(batch.schema.names, batch.columns)), "n_words": pa.array(counts, pa.int64()),
                       "hit_spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "hit_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return step


def report(found: DataFrame) -> DataFrame:
    """The digest of each document: counts of words, hit words and items, and a checksum of the item ids."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold an item's window; columns as before."""
    return find_items(docs, benchmark, **options).where(F.size("hit_spans") == 0).select([F.col(f"`{c}`") for c in docs.columns])
