"""Gradient-boosted trees with logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Boosted:
    """Complete binary trees of one depth over binned features; small enough to ship with a task."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    penalty: float = 1.0
    least: int = 5
    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1).astype(np.int32) if len(x) else np.zeros((0, len(self.cuts)), np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(np.r_[col, np.unique(col)], steps)) for col in x.T]
        codes, width = self._binned(x), self.bins
        p = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = _sigmoid(score)
            grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feats, cuts = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, np.int32)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-9)
                for j in range(x.shape[1]):
                    key = node * width + codes[:, j]
                    g, h, c = (np.bincount(key, v, count * width).reshape(count, width).cumsum(1) for v in (grad, hess, np.ones(len(y))))
                    gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                    gain = g**2 / (h + self.penalty) + (gt - g) ** 2 / (ht - h + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(c < self.least) | (ct - c < self.least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(count), at]
                    won = top > best
                    best[won] = top[won]
                    feats[first : first + count][won], cuts[first : first + count][won] = j, at[won]
                node = self._down(codes, node, feats[first : first + count], cuts[first : first + count])
            g, h = np.bincount(node, grad, 2**self.depth), np.bincount(node, hess, 2**self.depth)
            leaf = self.rate * g / (h + self.penalty)
            self.model.append((feats, cuts, leaf))
            score += leaf[node]
        return self

    @staticmethod
    def _down(codes: np.ndarray, node: np.ndarray, feats: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        f = feats[node]
        right = (codes[np.arange(len(codes)), np.maximum(f, 0)] > cuts[node]) & (f >= 0)
        return node * 2 + right

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, len(self.cuts))
        n, used = len(x), sorted({int(f) for feats, _, _ in self.model for f in feats if f >= 0})
        place = {f: i for i, f in enumerate(used)}
        codes = np.concatenate([np.searchsorted(self.cuts[f], x[:, f], side="right").astype(np.uint8) for f in used]) if used else np.zeros(n, np.uint8)
        score, row = np.full(n, self.base), np.arange(n)
        for feats, cuts, leaf in self.model:  # a node without a split sends all rows left
            start = np.array([place.get(int(f), 0) * n for f in feats])
            least = np.where(feats >= 0, cuts, 255).astype(np.uint8)
            node = (codes[start[0] : start[0] + n] > least[0]).astype(np.int64)
            for level in range(1, self.depth):
                at = node + (2**level - 1)
                node = node * 2 + (codes.take(start.take(at) + row) > least.take(at))
            score += leaf.take(node)
        return score


@dataclass
class Isotonic:
    """Monotone map from raw scores to probabilities: pooled adjacent violators, joined by straight lines."""

    at: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    value: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []  # weight, mean label, mean score
        for s, v in zip(score[order], y[order], strict=True):
            pools.append([1.0, float(v), float(s)])
            while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][2] >= pools[-1][2]):
                w, v1, s1 = pools.pop()
                u, v0, s0 = pools[-1]
                pools[-1] = [u + w, (u * v0 + w * v1) / (u + w), (u * s0 + w * s1) / (u + w)]
        if pools:
            w, v, s = np.array(pools).T
            self.at, self.value = s, (w * v + 0.5 * y.mean()) / (w + 0.5)  # a little shrinkage keeps single rows from 0 and 1
            self.value = np.maximum.accumulate(self.value)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        """Beyond the outer pools scores keep their order by a small logistic tail."""
        inside = np.interp(score, self.at, self.value)
        low, high = np.minimum(score - self.at[0], 0), np.maximum(score - self.at[-1], 0)
        return np.clip(inside * np.exp(low * 0.1) + (1 - inside) * (1 - np.exp(-high * 0.1)) * 0.5, 0, 1)
