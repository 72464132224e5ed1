"""Text quality by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins. The tables are learned by cyclic boosting: in turn for each feature a
shallow tree over the bins is fitted to what the model still gets wrong and added at a small rate. Then the pairs of
features that would gain most get tables of their own, learned the same way over a coarser grid. A score is the sigmoid
of the sum of one entry of each table, so scoring is binning and adding.

Features come from the whole text alone. Null and empty texts have the same features and get a score like any other;
without usable labels every score is the smoothed share of ones.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from shardloom.llm.boosting import best_cut, binned, edges_of, gain, leaf, log_odds, sigmoid
from shardloom.llm.labelled import collect_features, labelled_texts, score_texts

THRESHOLD = 0.3

NAMES = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "capitals", "digits", "stops", "marks", "signs", "bars",
    "quotes_brackets", "white", "lines_per_word", "same_as_before", "commonest_word", "distinct_words", "packed", "same_lines",
    "beyond_ascii", "words_with_sign", "capital_words",
)


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(characters)] = 1.0
    return out


_CLASSES = np.stack([
    _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b".,;:"), _class(b"!?"), _class(b"#$%&*@^~_=+"), _class(b"|"),
    _class(b"\"'()[]{}<>/\\"), _class(b" \t\r\n"), _class(bytes(range(128, 256))),
])
_SIGNS = bytes(c if c in b"#$%&*@^~_=+|!?<>{}[]\\/" else 32 for c in range(256))


def text_features(raw: bytes) -> list[float]:
    size = max(1, len(raw))
    share = _CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    words = raw.split()
    count = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    lines = raw.split(b"\n")
    before = sum(map(bytes.__eq__, words, words[1:]))
    signed = len(raw.translate(_SIGNS).split())
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.sum() / count, (lengths > 20).sum() / count, (lengths < 4).sum() / count,
        share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7], len(lines) / count, before / count,
        max(seen.values(), default=0) / count, len(seen) / count, len(zlib.compress(raw, 1)) / size, 1 - len(set(lines)) / len(lines),
        share[8], signed / count, sum(map(bytes.isupper, words)) / count,
    ]


def features(texts: list[bytes]) -> np.ndarray:
    return np.array([text_features(t) for t in texts], float).reshape(-1, len(NAMES))


def shallow(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over a row of bins, as one value for each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(parts)]
        (won, place), k = max(cuts)
        if not place:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + place), (a + place, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = leaf(g[a:b].sum(), h[a:b].sum())
    return out


def shallow_pair(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut of one feature, and on each side one of the other: gain and the values over the grid."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        gt, ht = (g.T, h.T) if turned else (g, h)
        for cut in range(1, gt.shape[0]):
            value, won = np.empty_like(gt), -float(gain(gt.sum(), ht.sum()))
            for side in (slice(0, cut), slice(cut, None)):
                gs, hs = gt[side].sum(axis=0), ht[side].sum(axis=0)
                more, place = best_cut(gs, hs)
                won += more + float(gain(gs.sum(), hs.sum()))
                value[side, :place] = leaf(gs[:place].sum(), hs[:place].sum())
                value[side, place:] = leaf(gs[place:].sum(), hs[place:].sum())
            if won > best[0]:
                best = (won, value.T if turned else value)
    return best


class AdditiveModel:
    """Lookup tables for single features and for pairs."""

    def __init__(self, rounds: int = 150, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.08, bins: int = 64, pair_bins: int = 8):
        self.rounds, self.pairs, self.pair_rounds, self.rate, self.bins, self.pair_bins = rounds, pairs, pair_rounds, rate, bins, pair_bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        count = x.shape[1]
        self.edges = [edges_of(x[:, f], self.bins) for f in range(count)]
        self.coarse = [edges_of(x[:, f], self.pair_bins) for f in range(count)]
        self.base = log_odds(y)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_tables: dict[tuple[int, int], np.ndarray] = {}
        b, c = binned(x, self.edges), binned(x, self.coarse)
        raw = np.full(len(y), self.base)
        if 0 < y.sum() < len(y):
            for _ in range(self.rounds):
                for f in range(count):
                    p = sigmoid(raw)
                    wide = len(self.tables[f])
                    step = self.rate * shallow(np.bincount(b[:, f], y - p, wide), np.bincount(b[:, f], p * (1 - p), wide))
                    self.tables[f] += step
                    raw += step[b[:, f]]
            self._fit_pairs(c, y, raw)
        return self

    def _grid(self, c: np.ndarray, pair: tuple[int, int], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, e = pair
        shape = len(self.coarse[f]) + 1, len(self.coarse[e]) + 1
        at = c[:, f] * shape[1] + c[:, e]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    def _fit_pairs(self, c: np.ndarray, y: np.ndarray, raw: np.ndarray) -> None:
        p = sigmoid(raw)
        won = {pair: shallow_pair(*self._grid(c, pair, y - p, p * (1 - p)))[0] for pair in combinations(range(c.shape[1]), 2)}
        for pair in sorted(won, key=lambda k: (-won[k], k))[: self.pairs]:
            self.pair_tables[pair] = np.zeros((len(self.coarse[pair[0]]) + 1, len(self.coarse[pair[1]]) + 1))
        for _ in range(self.pair_rounds):
            for pair, held in self.pair_tables.items():
                p = sigmoid(raw)
                step = self.rate * shallow_pair(*self._grid(c, pair, y - p, p * (1 - p)))[1]
                held += step
                raw += step[c[:, pair[0]], c[:, pair[1]]]

    def score(self, x: np.ndarray) -> np.ndarray:
        b, c = binned(x, self.edges), binned(x, self.coarse)
        raw = np.full(len(x), self.base)
        for f, held in enumerate(self.tables):
            raw += held[b[:, f]]
        for (f, e), held in self.pair_tables.items():
            raw += held[c[:, f], c[:, e]]
        return sigmoid(raw)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return self.score(features(texts))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", **options) -> AdditiveModel:
    x, y, _ = collect_features(labelled_texts(docs, labels, label, **options), [features])
    return AdditiveModel().fit(x, y)


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", name: str = "score") -> DataFrame:
    return score_texts(docs, model, text, name)


def keep_good(docs: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model rejects; columns as before."""
    name = "_" + "_".join(docs.columns)  # a name that no column has
    return score(docs, model, text, name).where(f"`{name}` >= {threshold}").drop(name)
