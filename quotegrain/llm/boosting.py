"""Gradient boosted trees for two classes on a small table, and a calibration of their scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    """Complete binary trees of one depth; node k has children 2k + 1 and 2k + 2."""

    rounds: int = 40
    depth: int = 4
    rate: float = 0.3
    ridge: float = 1.0
    bins: int = 32
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = _sigmoid(margin)
            tree = self._grow(binned, cuts, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _grow(self, binned, cuts, grad, bend):
        inner = 2**self.depth - 1
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**self.depth)
        at = np.zeros(len(grad), np.int64)
        for node in range(inner):
            own = at == node
            best = (1e-6, 0, np.inf)
            if own.sum() > 1:
                g, h = grad[own], bend[own]
                whole = g.sum() ** 2 / (h.sum() + self.ridge)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[own, j], g, len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h, len(c) + 1))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, float(c[k]))
            feature[node], cut[node] = best[1], best[2]
            right = own & (binned[:, best[1]] > np.searchsorted(cuts[best[1]], best[2])) if np.isfinite(best[2]) else np.zeros_like(own)
            at[own] = 2 * node + 1
            at[right] = 2 * node + 2
        leaf = at - inner
        g, h = np.bincount(leaf, grad, 2**self.depth), np.bincount(leaf, bend, 2**self.depth)
        value = -self.rate * g / (h + self.ridge)
        return feature, cut, value

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] >= cut[at])
        return value[at - (2**self.depth - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fit a slope and shift of the margin on rows that did not grow the trees."""
        m, w = self.margin(x), np.array([1.0, 0.0])
        design = np.c_[m, np.ones(len(m))]
        for _ in range(25):
            p = _sigmoid(design @ w)
            grade = design.T @ (p - y) + 1e-2 * (w - [1.0, 0.0])
            w = w - np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), grade)
        self.slope, self.shift = map(float, w)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.shift)
