"""Gradient-boosted trees for several classes, in numpy: histograms of quantile bins, one tree per class and round."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Softmax boosting.  ``fit`` takes a bounded training sample; ``probabilities`` works on arrays of any length."""

    def __init__(self, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.25, bins: int = 48, ridge: float = 2.0, least: int = 4):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = classes, rounds, depth, rate, bins, ridge, least
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        one = np.eye(self.classes)[y]
        # Rare classes count as much as frequent ones, within a factor of ten.
        weight = np.clip(n / (self.classes * np.maximum(one.sum(axis=0), 1)), 0.3, 3.0)[y]
        z = np.zeros((n, self.classes))
        for _ in range(self.rounds):
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            self.trees.append([])
            for c in range(self.classes):
                g, h = weight * (p[:, c] - one[:, c]), weight * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                tree, leaf = self._grow(binned, g, h)
                self.trees[-1].append(tree)
                z[:, c] += tree[2][leaf]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A complete tree: feature and threshold per inner node (feature -1: always left), value per leaf."""
        n, f = binned.shape
        width = self.bins + 1
        inner = 2**self.depth - 1
        feature, cut = np.full(inner, -1), np.full(inner, np.inf)
        node = np.zeros(n, dtype=int)
        flat = binned + np.arange(f) * width
        for level in range(self.depth):
            first = 2**level - 1
            for at in range(first, 2 * first + 1):
                mine = np.flatnonzero(node == at)
                if len(mine) < 2 * self.least:
                    node[mine] = 2 * at + 1
                    continue
                idx = flat[mine].ravel()
                gs, hs = (np.bincount(idx, np.repeat(v[mine], f), f * width).reshape(f, width).cumsum(axis=1) for v in (g, h))
                cs = np.bincount(idx, minlength=f * width).reshape(f, width).cumsum(axis=1)
                gt, ht, ct = gs[0, -1], hs[0, -1], cs[0, -1]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(cs < self.least) | (ct - cs < self.least)] = -np.inf
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] <= 1e-6 or b >= len(self.edges[j]):
                    node[mine] = 2 * at + 1
                    continue
                feature[at], cut[at] = j, self.edges[j][b]
                node[mine] = 2 * at + 1 + (binned[mine, j] > b)
        leaf = node - inner
        gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return (feature, cut, -self.rate * gl / (hl + self.ridge)), leaf

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.zeros((len(x), self.classes))
        rows = np.arange(len(x))
        for trees in self.trees:
            for c, (feature, cut, value) in enumerate(trees):
                node = np.zeros(len(x), dtype=int)
                for _ in range(self.depth):
                    j = feature[node]
                    right = (j >= 0) & (x[rows, np.maximum(j, 0)] > cut[node])
                    node = 2 * node + 1 + right
                z[:, c] += value[node - len(feature)]
        return z

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return p / p.sum(axis=1, keepdims=True) if len(z) else p

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Temperature with the least log loss on a holdout."""
        best = (np.inf, 1.0)
        for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0):
            self.temperature = t
            best = min(best, (float(-np.log(np.maximum(self.probabilities(x)[np.arange(len(y)), y], 1e-9)).mean()), t))
        self.temperature = best[1]
        return self
