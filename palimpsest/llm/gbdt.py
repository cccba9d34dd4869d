"""Gradient-boosted trees in numpy: logistic loss, histogram splits, calibrated output.

Small on purpose: it fits a bounded labelled sample on the driver and scores Arrow batches on
the workers, array by array.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 24
    l2: float = 1.0
    base: float = 0.0
    #: per tree: features, thresholds (depth-first heap of inner nodes) and leaf values
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        coded = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = prob - y, prob * (1 - prob)
            inner = 2**self.depth - 1
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            at = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(at == node)
                    best = self._split(coded[rows], g[rows], h[rows]) if len(rows) > 8 else None
                    if best and best[1] < len(edges[best[0]]):
                        feature[node], cut[node] = best[0], edges[best[0]][best[1]]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - inner
            n = 2**self.depth
            value = -np.bincount(leaf, weights=g, minlength=n) / (np.bincount(leaf, weights=h, minlength=n) + self.l2) * self.rate
            self.nodes.append((feature, cut, value))
            score = score + value[leaf]
        return self

    def _split(self, coded: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        total_g, total_h = g.sum(), h.sum()
        best, gain = None, 1e-6
        for f in range(coded.shape[1]):
            left_g = np.cumsum(np.bincount(coded[:, f], weights=g, minlength=self.bins))
            left_h = np.cumsum(np.bincount(coded[:, f], weights=h, minlength=self.bins))
            won = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
            k = int(won[:-1].argmax())
            if won[k] > gain:
                best, gain = (f, k), won[k]
        return best

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        line = np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[line, feature[at]] > cut[at])
            score += value[at - (2**self.depth - 1)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray, beta: float = 1.0) -> BoostedTrees:
        """Platt scaling on held-out rows, then the threshold of the best F-beta there."""
        z = self.raw(x)
        a, b = 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r = p - target
            w = p * (1 - p) + 1e-6
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([(r * z).sum(), r.sum()]))
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        self.slope, self.shift = float(a), float(b)
        p = self.probability(x)
        grid = np.linspace(0.1, 0.9, 33)
        hit = np.array([((p >= t) & (y > 0)).sum() for t in grid])
        taken = np.array([(p >= t).sum() for t in grid])
        score = (1 + beta**2) * hit / np.maximum(taken + beta**2 * y.sum(), 1)
        top = grid[score >= score.max() - 1e-9]
        self.threshold = float(np.median(top))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))
