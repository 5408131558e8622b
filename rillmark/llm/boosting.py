"""Gradient-boosted trees for two classes, and isotonic calibration, over small matrices."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Newton-boosted trees of fixed depth over binned features; the same rows give the same trees."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.edges: list[np.ndarray] = []
        self.base = 0.0
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        # the least value above zero also parts what most rows lack
        self.edges = [np.unique(np.append(e, v.min())) if len(v := x[x[:, f] > 0, f]) else e for f, e in enumerate(self.edges)]
        binned, width = self._binned(x), self.bins + 2
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            nodes = 1 << self.depth
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, width, np.int64)
            at = np.ones(len(y), np.int64)  # heap numbers
            for level in range(self.depth):
                first = 1 << level
                slot = at - first
                best = np.zeros(first)
                for f in range(x.shape[1]):
                    key = slot * width + binned[:, f]
                    gs = np.bincount(key, g, first * width).reshape(first, width).cumsum(axis=1)
                    hs = np.bincount(key, h, first * width).reshape(first, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    place = gain.argmax(axis=1)
                    top = gain[np.arange(first), place]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    feature[first:][: first][better], cut[first:][: first][better] = f, place[better]
                at = 2 * at + (binned[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - nodes
            value = self.rate * np.bincount(leaf, g, nodes) / (np.bincount(leaf, h, nodes) + self.ridge)
            raw += value[leaf]
            self.model.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        binned = self._binned(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.model:
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + (binned[rows, feature[at]] > cut[at])
            out += value[at - (1 << self.depth)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on score, by pooling adjacent violators; each block is drawn half a row towards the mean."""
    mean = float(y.mean()) if len(y) else 0.0
    level, at = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # sum, rows, lowest and highest score
    for s, v, n in zip(level.tolist(), np.bincount(at, y, len(level)).tolist(), np.bincount(at, minlength=len(level)).tolist(), strict=True):
        blocks.append([v, n, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    x = [v for b in blocks for v in (b[2], b[3])]
    p = [(b[0] + mean / 2) / (b[1] + 0.5) for b in blocks for _ in (0, 1)]
    return np.array(x), np.maximum.accumulate(np.array(p)) if p else np.array(p)
