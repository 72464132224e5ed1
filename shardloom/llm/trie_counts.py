"""Token counts under a unigram model, with forward scores shared in a trie of pre-tokens.

A pre-token is a run without white space, with the vocabulary's word mark before it. Each distinct pre-token is inserted
in a trie; a node holds the best log probability of any segmentation of the path to it and the number of tokens of that
segmentation, computed once from the nodes above it however many pre-tokens share the path. The last node of a pre-token
is its terminal; the tokens of a text are the sum of its terminals.

The model is the given vocabulary with a log probability for each piece. The files here list pieces by rank, so a piece of
rank r gets that of Zipf's law, proportional to 1 / (r + 1). A character that no piece holds costs ``UNKNOWN`` more than the
rarest piece and counts as its UTF-8 bytes. Of equal segmentations the one with the longest last piece counts.

A null or empty text has no tokens; copies count alike; texts of any length are counted whole. Columns named like the
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shardloom.llm.batches import map_batches, without

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
# Nodes of a worker's trie; beyond it the trie starts anew.
NODES = 600_000
# Longer pre-tokens are counted without leaving nodes behind.
LONGEST = 64


def piece_scores(path: str) -> dict[str, float]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks = {
        model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    }
    total = log(sum(1.0 / (r + 1.0) for r in ranks.values()))
    return {piece: -log(r + 1.0) - total for piece, r in ranks.items()}


class PreTokenTrie(dict):
    """Terminal counts by pre-token; a missing one is inserted in the trie."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values()) - UNKNOWN
        self.longest = max(map(len, scores))
        self._start()

    def _start(self) -> None:
        self.clear()
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def __missing__(self, word: str) -> int:
        if len(word) > LONGEST:
            return self._alone(MARK + word)
        if len(self.best) > NODES:
            self._start()
        marked = MARK + word
        path = [0]
        child, best, count = self.child, self.best, self.count
        for end, character in enumerate(marked, 1):
            edge = path[-1], character
            node = child.get(edge)
            if node is None:
                score, tokens = self._forward(marked, end, lambda start: (best[path[start]], count[path[start]]))
                node = child[edge] = len(best)
                best.append(score)
                count.append(tokens)
            path.append(node)
        self[word] = count[path[-1]]
        return self[word]

    def _forward(self, text: str, end: int, at) -> tuple[float, int]:
        """Best score and its tokens for ``text[:end]``, from those of the shorter prefixes."""
        found: tuple[float, int] | None = None
        scores = self.scores
        for start in range(max(0, end - self.longest), end):
            score = scores.get(text[start:end])
            if score is not None:
                before, tokens = at(start)
                if found is None or before + score > found[0]:
                    found = before + score, tokens + 1
        if text[end - 1] not in scores:
            before, tokens = at(end - 1)
            if found is None or before + self.unknown > found[0]:
                found = before + self.unknown, tokens + len(text[end - 1].encode("utf-8"))
        return found

    def _alone(self, text: str) -> int:
        states = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            states.append(self._forward(text, end, states.__getitem__))
        return states[-1][1]


@lru_cache(maxsize=2)
def trie(path: str) -> PreTokenTrie:
    """One trie for each vocabulary and Python worker."""
    return PreTokenTrie(piece_scores(path))


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with ``n_tokens`` and ``n_pretokens``; row-local."""
    path = path or public_tokenizers.path(VOCABULARY)
    df = without(df, ["n_tokens", "n_pretokens"])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]
                          + [T.StructField("n_tokens", T.LongType()), T.StructField("n_pretokens", T.LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = trie(path)
        for batch in batches:
            tokens, words = [], []
            for raw in batch.column(text).cast(pa.binary()).to_pylist():
                split = (raw or b"").decode("utf-8", "replace").split()
                words.append(len(split))
                tokens.append(sum(map(counts.__getitem__, split)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], [*batch.schema.names, "n_tokens", "n_pretokens"])

    return map_batches(df, step, schema)
