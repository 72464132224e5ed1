"""Boosted shallow trees over binned features: the parts that the classifiers share. Samples are bounded, arrays local."""

from __future__ import annotations

import numpy as np

# Added to the sum of second derivatives of a leaf, and the least such sum a leaf may have.
SHRINK = 1.0
LEAST_WEIGHT = 2.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def log_odds(y: np.ndarray) -> float:
    """Of the share of ones, smoothed so that one class alone is no certainty."""
    return float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner cuts of at most ``bins`` bins with about equal counts."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins (last axis); place 0 if there is none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    won = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
    won[(left_h < LEAST_WEIGHT) | (all_h - left_h < LEAST_WEIGHT)] = -1.0
    at = int(np.argmax(won))
    return (float(won[at]), at + 1) if won[at] > 1e-9 else (0.0, 0)


def leaf(g: float, h: float) -> float:
    return float(g / (h + SHRINK))


class Trees:
    """Gradient-boosted trees of fixed depth for a yes-or-no label."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [edges_of(x[:, f], self.bins) for f in range(x.shape[1])]
        self.base = log_odds(y)
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        b = binned(x, self.edges)
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = sigmoid(raw)
            tree = self._grow(b, y - p, p * (1 - p))
            self.grown.append(tree)
            raw += self._leaves(b, tree)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and cut of each inner node in level order (cut 0: all go right), and the values of the leaves."""
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, int), np.zeros(inner, int)
        node = np.zeros(len(g), int)
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            best = [(0.0, 0, 0)] * count
            for f, edges in enumerate(self.edges):
                width = len(edges) + 1
                at = (node - first) * width + b[:, f]
                gs = np.bincount(at, g, count * width).reshape(count, width)
                hs = np.bincount(at, h, count * width).reshape(count, width)
                for n in range(count):
                    won, place = best_cut(gs[n], hs[n])
                    if won > best[n][0]:
                        best[n] = (won, f, place)
            for n, (_, f, place) in enumerate(best):
                feature[first + n], cut[first + n] = f, place
            node = 2 * node + 1 + (b[np.arange(len(g)), feature[node]] >= cut[node])
        at = node - inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        return feature, cut, self.rate * gs / (hs + SHRINK)

    def _leaves(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, feature[node]] >= cut[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        out = np.full(len(x), self.base)
        for tree in self.grown:
            out += self._leaves(b, tree)
        return out


class Isotonic:
    """The rising step function closest to the labels, by pooling neighbours that fall."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        values, place = np.unique(raw, return_inverse=True)
        weight = np.bincount(place).astype(float)
        total = np.bincount(place, y)
        blocks: list[list[float]] = []  # sum, weight, number of values
        for t, w in zip(total, weight):
            blocks.append([t, w, 1])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                t2, w2, n2 = blocks.pop()
                blocks[-1][0] += t2
                blocks[-1][1] += w2
                blocks[-1][2] += n2
        ends = np.cumsum([b[2] for b in blocks])
        # A block reaches from its first to its last value; between blocks the function runs straight.
        self.at = np.concatenate([[values[e - int(b[2])], values[e - 1]] for b, e in zip(blocks, ends)])
        self.level = np.repeat([b[0] / b[1] for b in blocks], 2)
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.at, self.level), 0.0, 1.0)
