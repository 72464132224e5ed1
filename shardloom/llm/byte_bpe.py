"""Byte-level BPE in linear time: longest matches, compatibility of adjacent tokens, and backtracking.

A vocabulary of merge ranks decides which two tokens may stand side by side: they may if merging their bytes by rank
gives exactly these two tokens. The encoder takes the longest token at each place (one Aho-Corasick pass over the bytes
from the end, read as Latin-1), keeps it if it fits its left neighbour, else tries shorter prefixes, else steps back one token. A place
that led nowhere is never tried again, so the work stays linear, and the result is that of merging by rank.

A null text counts as empty and has no ids; texts of any length are encoded whole; broken UTF-8 is read with replacement
characters; copies of a row give equal rows. Columns named like the results are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shardloom.llm.batches import map_batches, without

VOCABULARY = "byte_bpe_50k.tiktoken"
# Entries of each worker's memory of encoded pieces, and of compatible pairs; beyond it a memory starts anew.
MEMORY = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder of one vocabulary; ranks are the token ids and hold all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token[::-1].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.lengths = [len(token) for token in self.tokens]
        self.shorter = [self._longest_prefix(token) for token in self.tokens]
        self.merged: dict[int, int] = {}
        self.halves: list[tuple[int, int]] = []
        self.fits: dict[int, bool] = {}
        for rank, token in enumerate(self.tokens):
            self.halves.append(self._split(rank, token))
        self.fits.clear()
        self.known: dict[str, bytes] = {}

    def _longest_prefix(self, token: bytes) -> int:
        for end in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:end])) is not None:
                return rank
        return -1

    def _split(self, rank: int, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; a token that no merge makes is both of its halves."""
        left = self.shorter[rank]
        while left >= 0:
            right = self.ranks.get(token[len(self.tokens[left]):])
            if right is not None and left < rank and right < rank and self._adjacent(left, right):
                self.merged[left * self.size + right] = rank
                return left, right
            left = self.shorter[left]
        return rank, rank

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave ``left`` and ``right`` side by side.

        The merges that made both sides are undone from the highest rank down; a pair at the seam that would have merged
        before the merge undone last means that the seam would not have survived.
        """
        size, merged, halves = self.size, self.merged, self.halves
        limit = size
        while True:
            pair = merged.get(left * size + right)
            if pair is not None and pair < limit:
                return False
            if left > right:
                limit, inner = left, halves[left][1]
                if inner == left:
                    limit, inner = right + 1, halves[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                limit, inner = right + 1, halves[right][0]
                if inner == right:
                    limit, inner = left, halves[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        # Read backwards, the matches that end at one place are the tokens that start there, the longest first.
        found = self.automaton.iter(piece[::-1].decode("latin-1"))
        longest = dict(reversed(list(found)))
        lengths, shorter, fits, size = self.lengths, self.shorter, self.fits, self.size
        if len(fits) > MEMORY:
            fits.clear()
        last = len(piece) - 1
        dead: set[int] = set()
        out: list[int] = []
        at, token, left = 0, longest[last], -1
        while True:
            end = at + lengths[token]
            good = end not in dead
            if good and left >= 0:
                key = left * size + token
                good = fits.get(key)
                if good is None:
                    good = fits[key] = self._adjacent(left, token)
            if good:
                out.append(token)
                if end > last:
                    return out
                at, left = end, token
                token = longest[last - at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                left = out[-1] if out else -1

    def _encode_match(self, match: str) -> bytes:
        ids = self.known.get(match)
        if ids is None:
            ids = array("I", self.encode_piece(match.encode("utf-8"))).tobytes()
            if len(match) < 64:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[match] = ids
        return ids

    def _encode_matches(self, text: str) -> bytes:
        return b"".join(map(self._encode_match, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers.

        Between words parted by single blanks the matches do not depend on each other: each blank starts a match with
        the word after it. A text with other white space beside a blank is matched as a whole.
        """
        first, *rest = text.split(" ")
        if not rest or first == "" or first[-1].isspace():
            return self._encode_matches(text)
        known, match, out = self.known, self._encode_match, [self._encode_matches(first)]
        for word in rest:
            ids = known.get(" " + word)
            if ids is None:
                core = word.rstrip(".,")
                if core.isalpha():  # letters, then at most one run of stops: two matches
                    ids = match(" " + core)
                    if len(core) < len(word):
                        ids += match(word[len(core):])
                elif word == "" or word[0].isspace() or word[-1].isspace():
                    return self._encode_matches(text)
                else:
                    ids = self._encode_matches(" " + word)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each vocabulary and Python worker."""
    return ByteBpe(load_ranks(path), pattern)


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    raw = batch.column(column).cast(pa.binary()).to_pylist()
    return ["" if value is None else value.decode("utf-8", "replace") for value in raw]


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    every = {**dict(zip(batch.schema.names, batch.columns)), **columns}
    return pa.RecordBatch.from_arrays(list(every.values()), list(every))


def _added(df: DataFrame, **columns: T.DataType) -> T.StructType:
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in columns.items()])


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``."""
    path = path or public_tokenizers.path(VOCABULARY)
    df = without(df, ["ids", "n_tokens"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t) for t in _texts(batch, text)]
            yield _with(batch, ids=pa.array(ids, pa.binary()), n_tokens=pa.array([len(i) // 4 for i in ids], pa.int64()))

    return map_batches(df, step, _added(df, ids=T.BinaryType(), n_tokens=T.LongType()))


def decode_ids(df: DataFrame, ids: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with ``decoded``, the bytes that the ids stand for; null ids give no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    df = without(df, ["decoded"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            yield _with(batch, decoded=pa.array([bpe.decode(i or b"") for i in batch.column(ids).to_pylist()], pa.binary()))

    return map_batches(df, step, _added(df, decoded=T.BinaryType()))


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode each text in one pass: ``doc_id``, ``n_tokens`` and checksums of ids and decoded bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            counts, sums, back = [], [], []
            for t in _texts(batch, text):
                ids = bpe.encode(t)
                counts.append(len(ids) // 4)
                sums.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums), pa.array(back)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kept = df.select("doc_id", text)
    kind = kept.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])
    return map_batches(kept, step, schema)
