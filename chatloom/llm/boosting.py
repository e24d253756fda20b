"""Gradient-boosted trees with logistic loss on binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees over at most ``bins`` quantile bins a feature."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 6.0, ridge: float = 2.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)))[:-1] for j in range(x.shape[1])]
        self.edges = [e if len(e) else np.array([np.inf]) for e in self.edges]
        binned = self._binned(x)
        rate = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            score += self._grow(binned, weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6))
        return self

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
        """One tree; histograms of all features of a node come from one count over (feature, bin) cells."""
        size, width, inner = 2 ** (self.depth + 1) - 1, binned.shape[1], 2**self.depth - 1
        bins = max(len(e) for e in self.edges) + 1
        cells = binned + np.arange(width) * bins
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        at = np.zeros(len(binned), np.int64)
        for node in range(size):
            here = np.flatnonzero(at == node)
            if not len(here):
                continue
            g, h = gradient[here], hessian[here]
            total_g, total_h = g.sum(), h.sum()
            value[node] = self.rate * total_g / (total_h + self.ridge)
            if node >= inner:
                continue
            flat = cells[here].ravel()
            left = [
                np.cumsum(np.bincount(flat, w, width * bins).reshape(width, bins), 1)[:, :-1]
                for w in (np.repeat(g, width), np.repeat(h, width), None)
            ]
            left_g, left_h, count = left
            gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge)
            gain -= total_g**2 / (total_h + self.ridge)
            gain[(count < self.least) | (len(here) - count < self.least)] = 0
            best = int(gain.argmax())
            if gain.ravel()[best] > 1e-3:
                feature[node], cut[node] = divmod(best, bins - 1)
                at[here] = 2 * node + 1 + (binned[here, feature[node]] > cut[node])
        self.nodes.append((feature, cut, value))
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds before calibration."""
        binned = self._binned(x)
        total = np.full(len(x), self.base)
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                goes = binned[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + goes, at)
            total += value[at]
        return total


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (upper score of each block, its rate), rates rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, w in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([s, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return np.array([b[0] for b in blocks]), np.array([b[1] / max(b[2], 1e-9) for b in blocks])


def calibrated(score: np.ndarray, curve: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rate of the block a score falls into, the last one for scores above all."""
    upper, rate = curve
    return rate[np.minimum(np.searchsorted(upper, score, side="left"), len(rate) - 1)]
