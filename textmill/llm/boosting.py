"""Gradient-boosted trees for a binary target on a small dense table, with calibration. numpy only."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited regression trees on the logistic loss with second-order leaf values, over quantile bins.

    Trees are complete binary trees kept in arrays (feature, threshold, leaf value), so a batch is scored with
    ``depth`` gathers a tree. Deterministic: ties go to the lower feature and the lower threshold.
    """

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, reg: float = 1.0, bins: int = 32):
        self.trees, self.depth, self.rate, self.reg, self.bins = trees, depth, rate, reg, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        inner, width = 2**self.depth - 1, self.bins + 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, 2**self.depth))
        score = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(2**level):
                    at = np.flatnonzero(node == first + k)
                    if len(at) < 8:
                        continue
                    best = (1e-9, 0, np.inf)
                    whole = g[at].sum() ** 2 / (h[at].sum() + self.reg)
                    for j in range(d):
                        if not len(cuts[j]):
                            continue
                        gl = np.cumsum(np.bincount(code[at, j], g[at], width))[: len(cuts[j])]
                        hl = np.cumsum(np.bincount(code[at, j], h[at], width))[: len(cuts[j])]
                        gr, hr = g[at].sum() - gl, h[at].sum() - hl
                        gain = gl**2 / (hl + self.reg) + gr**2 / (hr + self.reg) - whole
                        b = int(np.argmax(gain))
                        if gain[b] > best[0] + 1e-12:
                            best = (gain[b], j, cuts[j][b])
                    self.feature[t, first + k], self.cut[t, first + k] = best[1], best[2]
                f, c = self.feature[t, node], self.cut[t, node]
                node = 2 * node + 1 + (x[np.arange(n), f] > c)
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            self.leaf[t] = -self.rate * gs / (hs + self.reg)
            score += self.leaf[t, leaf]
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.leaf[t, node - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators calibration: (ascending scores, calibrated probability from each on)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, _ = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def calibrated(score: np.ndarray, curve: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at = np.searchsorted(curve[0], score, side="right") - 1
    return curve[1][np.maximum(at, 0)]
