"""Gradient-boosted trees for a binary target, with isotonic calibration; numpy on a bounded sample."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, histogram splits, trees of fixed depth. Deterministic: no sampling, ties go to the first split."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[list[tuple[int, float, float]]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, m = x.shape
        w = np.ones(n) if weight is None else weight.astype(float)
        p = min(max(float((w * y).sum() / w.sum()), 1e-4), 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        # bins by quantiles of distinct values: many rows share a value of 0
        edges = []
        for j in range(m):
            v = np.unique(x[:, j])
            edges.append((v[:-1] + v[1:]) / 2 if len(v) <= self.bins else np.unique(np.quantile(v, np.arange(1, self.bins) / self.bins)))
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = w * (y - q), w * q * (1 - q)
            node = np.zeros(n, np.int64)
            tree: list[tuple[int, float, float]] = []  # (feature or -1, edge, value), as a heap
            for level in range(self.depth):
                first = (1 << level) - 1
                best = [(0.0, -1, 0)] * (1 << level)
                for j, e in enumerate(edges):
                    k = len(e) + 1
                    if k < 2:
                        continue
                    at = (node - first) * k + code[:, j]
                    sg = np.bincount(at, g, k << level).reshape(-1, k).cumsum(axis=1)
                    sh = np.bincount(at, h, k << level).reshape(-1, k).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.ridge) + (tg - sg) ** 2 / (th - sh + self.ridge) - tg**2 / (th + self.ridge)
                    gain[(sh < self.least * 0.1) | (th - sh < self.least * 0.1)] = 0
                    top = gain[:, :-1].argmax(axis=1)
                    for a, t in enumerate(top.tolist()):
                        if gain[a, t] > best[a][0] + 1e-9:
                            best[a] = (float(gain[a, t]), j, t)
                feature = np.array([b[1] for b in best])
                cut = np.array([b[2] for b in best])
                tree += [(b[1], float(edges[b[1]][b[2]]) if b[1] >= 0 else 0.0, 0.0) for b in best]
                f, c = feature[node - first], cut[node - first]
                right = (f >= 0) & (code[np.arange(n), np.maximum(f, 0)] > c)
                node = 2 * node + 1 + right
            first = (1 << self.depth) - 1
            sg, sh = np.bincount(node - first, g, 1 << self.depth), np.bincount(node - first, h, 1 << self.depth)
            value = self.rate * sg / (sh + self.ridge)
            tree += [(-1, 0.0, float(v)) for v in value]
            score += value[node - first]
            self.trees.append(tree)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree in self.trees:
            feature, edge, value = (np.array(a) for a in zip(*tree))
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > edge[node]))
            score += value[node]
        return score

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


class Isotonic:
    """Pool adjacent violators; between the centres of blocks the calibrated value is interpolated."""

    def __init__(self) -> None:
        self.x, self.y = np.zeros(1), np.zeros(1)

    def fit(self, p: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(p):
            self.x, self.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
            return self
        at = np.unique(p)
        place = np.searchsorted(at, p)
        blocks: list[list[float]] = []  # [sum of y, rows, sum of p]
        for s, k, q in zip(np.bincount(place, y).tolist(), np.bincount(place).tolist(), np.bincount(place, p).tolist()):
            blocks.append([s, k, q])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.array([b[0] / b[1] for b in blocks])
        return self

    def predict(self, p: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(p, self.x, self.y), 0.0, 1.0)
