"""The best few of each row, kept while candidates come in."""

from __future__ import annotations

import numpy as np


class Best:
    """The best k of each of n rows: by greater key, equal ones by lower pos. A key of -inf is an empty place."""

    def __init__(self, n: int, k: int):
        self.k, self.keys, self.pos = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> None:
        own = np.unique(rows)
        rows, keys, pos = (np.concatenate(x) for x in ((np.repeat(own, self.k), rows), (self.keys[own].ravel(), keys), (self.pos[own].ravel(), pos)))
        order = np.lexsort((pos, -keys, rows))
        begin = np.searchsorted(rows[order], own)
        best = order[(begin[:, None] + np.arange(self.k)).ravel()]  # every row has its k old places at least
        self.keys[own], self.pos[own] = keys[best].reshape(-1, self.k), pos[best].reshape(-1, self.k)
