"""Gradient-boosted trees for two classes, small enough to train on the driver: complete trees of fixed depth over binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.depth, self.base = depth, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        self.features, self.cuts, self.leaves = [], [], []
        raw = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                width, first = 2**level, 2**level - 1
                best, choice = np.zeros(width), [(0, -1)] * width
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = node * (len(e) + 1) + binned[:, j]
                    gs = np.bincount(key, g, width * (len(e) + 1)).reshape(width, -1).cumsum(1)
                    hs = np.bincount(key, h, width * (len(e) + 1)).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = (gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2))[:, :-1]
                    at = gain.argmax(1)
                    for n in range(width):
                        if gain[n, at[n]] > best[n] + 1e-9:
                            best[n], choice[n] = gain[n, at[n]], (j, int(at[n]))
                right = np.zeros(len(y), bool)
                for n, (j, b) in enumerate(choice):
                    if b >= 0:
                        feature[first + n], cut[first + n] = j, edges[j][b]
                        here = node == n
                        right[here] = binned[here, j] > b
                node = node * 2 + right
            value = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2)
            self.features.append(feature)
            self.cuts.append(cut)
            self.leaves.append(value)
            raw = raw + value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset that calibrate raw scores, by Newton steps on the logistic loss."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * raw).sum() - 1e-2 * a, (y - p).sum() - 1e-2 * b])
        m = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-2]])
        d = np.linalg.solve(m, g)
        a, b = a + d[0], b + d[1]
        if abs(d).max() < 1e-9:
            break
    return float(a), float(b)
