"""A batch model for the pluggable embedder that needs no download."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from shardloom.catalog.inputs import HASH_DIM


def load_hashing_model():
    """Signed feature hashing of words, equal to :func:`shardloom.functions.vectors.hash_embed`."""

    @lru_cache(maxsize=100_000)
    def code(word: str) -> tuple[int, int]:
        digest = hashlib.md5(word.encode()).hexdigest()
        return int(digest[:8], 16) % HASH_DIM, 1 if digest[8] < "8" else -1

    def model(texts: Sequence[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            vector = np.zeros(HASH_DIM)
            for bucket, sign in map(code, text.lower().split()):
                vector[bucket] += sign
            norm = np.linalg.norm(vector)
            # Words that cancel each other out leave no direction.
            out.append((vector / norm).tolist() if norm else None)
        return out

    return model
