"""Small gradient-boosted trees with isotonic calibration, for bounded samples, in NumPy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, histogram splits, trees of one depth stored as full binary trees."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, least: int = 8, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.penalty = rounds, depth, rate, bins, least, penalty
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        p = (y.sum() + 0.5) / (n + 1)
        self.start = float(np.log(p / (1 - p)))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) if d else np.zeros((n, 0), int)
        raw = np.full(n, self.start)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-raw))
            grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-9)
            tree = self._grow(binned, grad, hess)
            self.trees.append(tree)
            raw += self._leaf(tree, x)
        return self

    def _grow(self, binned, grad, hess):
        inner = 2**self.depth - 1
        feature, cut = np.full(inner, -1), np.zeros(inner)
        node = np.zeros(len(grad), dtype=np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = None
            if len(rows) >= 2 * self.least:
                g, h = grad[rows], hess[rows]
                gs, hs = g.sum(), h.sum()
                base = gs * gs / (hs + self.penalty)
                for j, cuts in enumerate(self.cuts):
                    if not len(cuts):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(cuts) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                    gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - base
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k)
            if best is None:
                node[rows] = 2 * at + 1
            else:
                _, j, k = best
                feature[at], cut[at] = j, self.cuts[j][k]
                node[rows] = 2 * at + 1 + (binned[rows, j] > k)
        leaf = node - inner
        size = inner + 1
        value = -self.rate * np.bincount(leaf, weights=grad, minlength=size) / (np.bincount(leaf, weights=hess, minlength=size) + self.penalty)
        return feature, cut, value

    def _leaf(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            at = 2 * at + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[at]))
        return value[at - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self._leaf(tree, x)
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: places and values of the non-decreasing fit, one pair per block."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a2, b2, w2 = blocks.pop()
            a1, b1, w1 = blocks.pop()
            w = w1 + w2
            blocks.append([(a1 * w1 + a2 * w2) / w, (b1 * w1 + b2 * w2) / w, w])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])
