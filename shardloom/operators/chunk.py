"""Overlapping text windows. Each document is split inside its own row; nothing is shuffled."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.rows import let
from shardloom.functions.text import clean_markdown, trim_ws, words

# Markdown separators, tried in this order.
MARKDOWN_SEPARATORS = ("\n# ", "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "\n\n", "\n", " ")

# A text of several times so many pieces is a long one; tests split such texts.
PIECES_PER_BLOCK = 256


def _check(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("window size must be >= 1 and the overlap smaller than it.")


def word_windows(text: Column, size: int, overlap: int, min_words: int) -> Column:
    """ARRAY<STRING> of windows of ``size`` words, each starting ``size - overlap`` after the last."""
    _check(size, overlap)
    step = size - overlap

    def windows(tokens: Column) -> Column:
        last = F.greatest(F.ceil((F.size(tokens) - size) / F.lit(step)), F.lit(0)).cast("int")
        starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step + 1)
        long_enough = F.filter(starts, lambda s: F.least(F.size(tokens) - s + 1, F.lit(size)) >= max(min_words, 1))
        return F.transform(long_enough, lambda s: F.concat_ws(" ", F.slice(tokens, s, size)))

    return let(words(text), windows)


def count_words(text: str) -> int:
    return len(text.split())


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that each begin with the separator, except a first piece before any."""
    head, *rest = text.split(separator)
    return [piece for piece in [head, *(separator + part for part in rest)] if piece]


def _pack(pieces: list[tuple[str, int]], size: int, overlap: int) -> Iterator[str]:
    """Greedy windows over the counted pieces; each keeps a tail of the last one no longer than the overlap."""
    window: deque[tuple[str, int]] = deque()
    total = 0
    for piece in pieces:
        length = piece[1]
        if window and total + length > size:
            yield "".join([p for p, _ in window])
            while window and (total > overlap or total + length > size):
                total -= window.popleft()[1]
        window.append(piece)
        total += length
    if window:
        yield "".join([p for p, _ in window])


def split_recursively(text: str, size: int, overlap: int, count: Callable[[str], int],
                      separators: tuple[str, ...] = MARKDOWN_SEPARATORS) -> list[str]:
    """Split at the first separator present, pack the pieces, and split again what is still too long."""
    present = [i for i, s in enumerate(separators) if s in text]
    separator = separators[present[0]] if present else separators[-1]
    finer = separators[present[0] + 1:] if present else ()
    out: list[str] = []
    short: list[tuple[str, int]] = []
    for piece in _cut(text, separator):
        length = count(piece)
        if length < size:
            short.append((piece, length))
            continue
        out.extend(_pack(short, size, overlap))
        short = []
        out.extend(split_recursively(piece, size, overlap, count, finer) if finer else [piece])
    out.extend(_pack(short, size, overlap))
    return [w for w in map(str.strip, out) if w]


def markdown_windows(text: Column, size: int, overlap: int, min_words: int,
                     separators: tuple[str, ...] = MARKDOWN_SEPARATORS,
                     counter: Callable[[], Callable[[str], int]] | None = None) -> Column:
    """ARRAY<STRING> of windows that open at headings where they can, else at blank lines, line feeds or spaces.

    The text is cut before each first-level heading and its pieces are packed into windows; what alone is too long goes to
    the next separator, down to single words. Neighbouring windows share whole pieces of up to ``overlap`` words. The minimum
    applies to finished windows. ``counter`` builds another measure than words, once per worker task.
    """
    _check(size, overlap)

    @F.pandas_udf("array<string>")
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter() if counter else count_words
        for texts in batches:
            yield texts.map(
                lambda t: [w for w in split_recursively(t, size, overlap, count, separators) if count(w) >= min_words] if t else []
            )

    return windows(text)


def _explode(df: DataFrame, windows: Column, text: str, uid: str) -> DataFrame:
    others = [F.col(f"`{c}`") for c in df.columns if c not in (text, uid, "parent_uid", "chunk_index", "chunk_count")]
    # The windows are the generator's own argument: as a column, or behind a filter, they would be
    # computed once more to drop documents without any.
    counted = let(windows, lambda w: F.transform(w, lambda x: F.struct(F.size(w).alias("count"), x.alias("text"))))
    exploded = df.select(*others, F.col(uid), F.posexplode(counted).alias("_pos", "_chunk")).select(
        *others, F.col(uid), "_pos", F.col("_chunk.count").alias("chunk_count"), F.col("_chunk.text").alias(text)
    )
    index = F.col("_pos") + 1
    base = trim_ws(F.col(uid).cast("string"))
    renamed = (F.col("chunk_count") > 1) & (base != "")
    return exploded.select(
        *others,
        F.when(renamed, F.concat_ws("_", base, index)).otherwise(F.col(uid).cast("string")).alias(uid),
        F.col(text),
        index.alias("chunk_index"),
        "chunk_count",
        F.when(renamed, base).alias("parent_uid"),
    )


def chunk_words(df: DataFrame, text: str = "text", uid: str = "uid", size: int = 400, overlap: int = 80,
                min_words: int = 100) -> DataFrame:
    """One row per word window with ``chunk_index`` (from 1), ``chunk_count`` and, when split, ``parent_uid``."""
    return _explode(df, word_windows(F.col(text), size, overlap, min_words), text, uid)


def chunk_markdown(df: DataFrame, text: str = "text", uid: str = "uid", size: int = 400, overlap: int = 80,
                   min_words: int = 100, clean: bool = True) -> DataFrame:
    """Like :func:`chunk_words`, after image removal, with windows that open at headings where they can."""
    source = clean_markdown(F.col(text)) if clean else F.col(text)
    return _explode(df, markdown_windows(source, size, overlap, min_words), text, uid)


def chunk_recursive(df: DataFrame, text: str = "text", uid: str = "uid", size: int = 400, overlap: int = 80,
                    min_tokens: int = 100, counter: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """Recursive markdown splitting measured by a token counter, or by words.

    ``counter`` builds the counting function, once per worker task (a byte-pair tokenizer, for example). Its counts of
    two pieces need not add up.
    """
    if counter is None:
        return chunk_markdown(df, text, uid, size, overlap, min_tokens)
    windows = markdown_windows(clean_markdown(F.col(text)), size, overlap, min_tokens, counter=counter)
    return _explode(df, windows, text, uid)
