"""Token ids in files of patched frame-of-reference blocks.

Layout of a file, all numbers little-endian:

    8 bytes     magic and version
    blocks      each: minimum u32, width u8, zero u8, exceptions u16, packed values as u64 words,
                exception places as u16, exception values as u32
    block index start of each block as u64
    documents   key u64 (two's complement of doc_id, flag apart), number of ids u64, null flag u8, each as one column
    footer      ids u64, block count u64, document count u64, start of the block index u64, magic

A block holds ``BLOCK`` ids (the last one of a file fewer). Its minimum is subtracted; the width is the number of bits that
hold the ``PERCENTILE`` share of what is left; larger values keep their low bits in place and stand whole in the list of
exceptions. The block index lets a reader decode any range of ids alone.

Files follow ascending ``doc_id`` (nulls first, equal ids by text). A null or empty text has only the end id. Long texts
run over as many blocks as they need, and a file ends at the first document that fills it. A special token's name that
stands in a text, such as ``<|endoftext|>``, is that token, as the library reads it by default. Broken UTF-8 is read with
replacement characters. An empty table gives no files.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from shardloom.llm.batches import map_batches
from shardloom.session import materialize, scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"SLPFOR01"
BLOCK = 1024
PERCENTILE = 0.97
# A file ends with the first document after so many ids (about 8 MB).
FILE_IDS = 4 << 20
# Entries of a worker's memory of encoded words.
MEMORY = 500_000
# ASCII punctuation but for the apostrophe, which may begin a pre-token with letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


# --- packing ---------------------------------------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of 64-bit words; 64 values take ``width`` words."""
    rows, count = values.shape
    if width == 0:
        return np.zeros((rows, 0), np.uint64)
    groups = -(-count // 64)
    lanes = np.zeros((rows, groups * 64), np.uint64)
    lanes[:, :count] = values
    lanes = lanes.reshape(rows, groups, 64)
    words = np.zeros((rows, groups, width), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        words[:, :, word] |= lanes[:, :, lane] << np.uint64(shift)
        if shift + width > 64:
            words[:, :, word + 1] |= lanes[:, :, lane] >> np.uint64(64 - shift)
    return words.reshape(rows, groups * width)


def _unpack(words: np.ndarray, width: int, count: int) -> np.ndarray:
    rows = words.shape[0]
    if width == 0:
        return np.zeros((rows, count), np.uint64)
    words = words.reshape(rows, -1, width)
    lanes = np.empty((rows, words.shape[1], 64), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, :, word + 1] << np.uint64(64 - shift))
        lanes[:, :, lane] = value & np.uint64((1 << width) - 1)
    return lanes.reshape(rows, -1)[:, :count]


_BITS = np.uint64(1) << np.arange(33, dtype=np.uint64)


def _same_length(chunk: np.ndarray) -> list[bytes]:
    """Blocks from the rows of ``chunk``."""
    low = chunk.min(axis=1)
    rest = (chunk - low[:, None]).astype(np.uint64)
    place = min(rest.shape[1] - 1, int(PERCENTILE * rest.shape[1]))
    widths = np.searchsorted(_BITS, np.partition(rest, place, axis=1)[:, place], side="right")
    blocks: list[bytes] = [b""] * len(chunk)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        values = rest[rows]
        packed = _pack(values & (_BITS[width] - np.uint64(1)), int(width))
        over = values >= _BITS[width]
        for k, row in enumerate(rows):
            where = np.flatnonzero(over[k])
            blocks[row] = b"".join((
                int(low[row]).to_bytes(4, "little"), bytes([int(width), 0]), len(where).to_bytes(2, "little"),
                packed[k].astype("<u8").tobytes(), where.astype("<u2").tobytes(), values[k][where].astype("<u4").tobytes(),
            ))
    return blocks


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All ids as blocks, and the start of each block in the bytes."""
    parts: list[bytes] = []
    # Some hundred blocks at a time keep the intermediate arrays small.
    for first in range(0, len(ids), 256 * BLOCK):
        some = ids[first : first + 256 * BLOCK]
        full = len(some) // BLOCK * BLOCK
        if full:
            parts += _same_length(some[:full].reshape(-1, BLOCK))
        if full < len(some):
            parts += _same_length(some[full:][None])
    starts = np.array([0, *accumulate(map(len, parts))], np.int64)[:-1]
    return b"".join(parts), starts


def decode_blocks(data: memoryview, starts: list[int], counts: list[int]) -> np.ndarray:
    """The ids of the blocks at ``starts``, one after another; blocks of one width are unpacked together."""
    out = [np.zeros(0, np.uint32)] * len(starts)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (start, count) in enumerate(zip(starts, counts)):
        alike.setdefault((data[start + 4], count), []).append(k)
    for (width, count), group in alike.items():
        words = -(-count // 64) * width
        packed = np.stack([np.frombuffer(data, "<u8", words, starts[k] + 8) for k in group])
        for k, values in zip(group, _unpack(packed, width, count)):
            start = starts[k]
            wrong = int.from_bytes(data[start + 6 : start + 8], "little")
            if wrong:
                at = start + 8 + 8 * words
                values[np.frombuffer(data, "<u2", wrong, at)] = np.frombuffer(data, "<u4", wrong, at + 2 * wrong)
            out[k] = (values + np.uint64(int.from_bytes(data[start : start + 4], "little"))).astype(np.uint32)
    return np.concatenate(out)


def write_file(ids: np.ndarray, keys: list[int | None], lengths: list[int]) -> bytes:
    blocks, starts = encode_blocks(ids)
    index_at = len(MAGIC) + len(blocks)
    return b"".join((
        MAGIC, blocks, (starts + len(MAGIC)).astype("<u8").tobytes(),
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(),
        np.array([k is None for k in keys], "u1").tobytes(),
        np.array([len(ids), len(starts), len(keys), index_at], "<u8").tobytes(), MAGIC,
    ))


class TokenFile:
    """Reader of one file's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a whole token file")
        self.n_ids, self.n_blocks, self.n_docs, at = (int(x) for x in np.frombuffer(data, "<u8", 4, len(data) - len(MAGIC) - 32))
        self.starts = np.frombuffer(data, "<u8", self.n_blocks, at)
        at += 8 * self.n_blocks
        self.keys = np.frombuffer(data, "<i8", self.n_docs, at)
        self.lengths = np.frombuffer(data, "<u8", self.n_docs, at + 8 * self.n_docs).astype(np.int64)
        self.is_null = np.frombuffer(data, "u1", self.n_docs, at + 16 * self.n_docs)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` of the file; only the blocks that hold them are decoded."""
        if end <= first:
            return np.zeros(0, np.uint32)
        blocks = range(first // BLOCK, -(-end // BLOCK))
        starts = [int(self.starts[b]) for b in blocks]
        ids = decode_blocks(self.data, starts, [min(BLOCK, self.n_ids - b * BLOCK) for b in blocks])
        return ids[first - blocks.start * BLOCK : end - blocks.start * BLOCK]

    def documents(self, stretch: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id in the file, ids) of each document; about ``stretch`` ids are decoded at a time."""
        ends = np.cumsum(self.lengths)
        doc = 0
        while doc < self.n_docs:
            first = int(ends[doc] - self.lengths[doc])
            last = max(doc + 1, int(np.searchsorted(ends, first + stretch, side="right")))
            ids = self.ids(first, int(ends[last - 1]))
            for d in range(doc, last):
                end = int(ends[d])
                begin = end - int(self.lengths[d])
                yield (None if self.is_null[d] else int(self.keys[d])), begin, ids[begin - first : end - first]
            doc = last


# --- encoding --------------------------------------------------------------------------------------------------------


def _plain(word: str) -> bool:
    """Letters only, also after the vocabulary's normaliser."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def _folded(word: str) -> str:
    """As the vocabulary's normaliser lowers it, where that is beyond doubt."""
    return word.lower() if word.isascii() else word


class WordCodec:
    """Ids of whole texts by a vocabulary whose pre-tokens never hold white space.

    Words of letters occur again and again, so each worker encodes them once, many in one call of the tokenizers library;
    what is no plain word goes to the library as it stands.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """Each word of letters ends with its only end-of-word token, so one call serves many words."""
        for at in range(0, len(words), 5_000):
            some = words[at : at + 5_000]
            ids = self._ids(" ".join(some))
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(some):
                raw = ids.tobytes()
                self.known.update((w, raw[a:b]) for w, a, b in zip(some, [0, *cuts], cuts))
            else:
                self.known.update((w, self._ids(w).tobytes()) for w in some)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and the end id."""
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        split = [text.replace("\n", " ").split(" ") for text in texts]
        cores: dict[str, str] = {}
        for word in set().union(*split) - known.keys():
            core = word.rstrip(_MARKS)
            cores[word] = core if _plain(core) else ""  # letters, then at most one run of marks
        self._learn([core for core in set(map(_folded, cores.values())) if core and core not in known])
        own: dict[str, bytes] = {"": b""}
        for word, core in cores.items():
            folded = _folded(core)
            if folded != word or not core:
                rest = word[len(core):]
                if core and rest not in own:
                    own[rest] = self._ids(rest).tobytes()
                own[word] = known[folded] + own[rest] if core else self._ids(word).tobytes()
        known.update(own)
        end = np.array([END_ID], "<u4").tobytes()
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)) + end, "<u4") for words in split]
        for word in own:  # what is no plain word is seldom seen again
            del known[word]
        return out


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordCodec(path)


# --- jobs ------------------------------------------------------------------------------------------------------------


def _put(folder: str, name: str, data: bytes) -> None:
    """Write under another name, then move: a file is whole or not there, whichever attempt of a task wrote it."""
    system, path = pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://") if "://" in folder else f"file://{folder}" if folder.startswith("/") else "file://" + folder.removeprefix("file:"))
    system.create_dir(path, recursive=True)
    draft = f"{path}/_{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{path}/{name}")


def write_token_files(df: DataFrame, folder: str, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Encode ``df`` in ascending key order into files below ``folder``; returns the list of files.

    Texts are dealt by ranges of the key before they are encoded: they are smaller than their ids. Tasks write the files
    through Arrow's file systems, so ``folder`` must be one that all executors reach.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    # Equal rows may stand in any order; the scan position lets many of them lie in several ranges.
    order = [F.asc_nulls_first("key"), F.asc_nulls_first("text_hash"), F.asc("at")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        rows.withColumns({"text_hash": F.xxhash64("text"), "at": F.monotonically_increasing_id()}).repartitionByRange(parts, *order)
        .sortWithinPartitions(*order).select("key", "text", F.spark_partition_id().alias("part"))
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        keys: list = []
        held: list[np.ndarray] = []
        part = number = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}.ids"
            ids = np.concatenate(held)
            _put(folder, name, write_file(ids, keys, [len(x) for x in held]))
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(keys)], "n_ids": [len(ids)]})

        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            texts = ["" if t is None else t.decode("utf-8", "replace") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for k, ids in zip(batch.column("key").to_pylist(), codec.encode(texts)):
                keys.append(k)
                held.append(ids)
                total += len(ids)
                if total >= FILE_IDS:
                    yield flush()
                    keys, held, total, number = [], [], 0, number + 1
        if held:
            yield flush()

    return materialize(map_batches(dealt, step, "file string, n_docs bigint, n_ids bigint"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids as binary.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is taken over the ids as they are read. The list of
    files has one short row for each.
    """
    # Files are part-<range>-<number>.ids; numbers may have any number of digits.
    place = [F.regexp_extract("file", r"part-(\d+)-(\d+)", k).cast("bigint") for k in (1, 2)]
    order = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    before = manifest.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def rows_of(name: str, rows: list[tuple]) -> pa.RecordBatch:
        key, begin, count, crc, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(rows)), *(pa.array(x, pa.int64()) for x in (key, begin, count, crc)), pa.array(ids, pa.binary())],
            ["file", "doc_id", "begin", "n_tokens", "ids_crc32", "ids"],
        )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                rows: list[tuple] = []
                held = 0
                for key, begin, ids in TokenFile(content.as_buffer().to_pybytes()).documents():
                    raw = ids.astype("<u4").tobytes()
                    rows.append((key, begin, len(ids), zlib.crc32(raw), raw if with_ids else None))
                    held += len(raw)
                    if held >= 8 << 20:
                        yield rows_of(name, rows)
                        rows, held = [], 0
                if rows:
                    yield rows_of(name, rows)

    read = map_batches(named, step, "file string, doc_id bigint, begin bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    wanted = ["doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"]
    return read.join(before, "file").select(*wanted, *["ids"] * with_ids)


def encode_corpus(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> tuple[str, DataFrame]:
    """Folder and manifest of the token files of ``df``, in the shared folder."""
    folder = scratch_path(df.sparkSession, "tokens")
    return folder, write_token_files(df, folder, text, key, path)
