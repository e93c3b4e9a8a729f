"""Gradient-boosted trees for a yes-or-no label, small and in NumPy; training is a driver's work on a bounded sample."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Tree(NamedTuple):
    """A complete binary tree by levels: feature and cut of inner node i, whose children are 2i + 1 and 2i + 2; values of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


class Model(NamedTuple):
    base: float
    trees: list[Tree]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        out = np.full(len(x), self.base)
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(t.value)))):
                at = 2 * at + 1 + (x[np.arange(len(x)), t.feature[at]] > t.cut[at])
            out += t.value[at - len(t.feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.score(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> Model:
    """Newton boosting of the logistic loss on quantile bins; ties take the first feature and cut."""
    n, m = x.shape
    p = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    score = np.full(n, np.log(p / (1 - p)))
    base, made = float(score[0]) if n else 0.0, []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    sizes = np.array([len(c) + 1 for c in cuts])
    first = np.cumsum(sizes) - sizes
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) + first  # every feature's bins in one row of bins
    of, whole = np.repeat(np.arange(m), sizes), int(sizes.sum())
    splits = np.ones(whole, dtype=bool)
    splits[first + sizes - 1] = False  # past a feature's last bin nothing is left
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        inner = 2**depth - 1
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-9, 0, np.inf)
            if len(rows) > 1:
                gt, ht, at_bins = g[rows].sum(), h[rows].sum(), binned[rows].ravel()
                gl = np.cumsum(np.bincount(at_bins, np.repeat(g[rows], m), whole)) - of * gt
                hl = np.cumsum(np.bincount(at_bins, np.repeat(h[rows], m), whole)) - of * ht
                gain = np.where(splits, gl**2 / (np.maximum(hl, 0) + penalty) + (gt - gl) ** 2 / (np.maximum(ht - hl, 0) + penalty) - gt**2 / (ht + penalty), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(of[k]), float(cuts[of[k]][k - first[of[k]]]))
            feature[node], cut[node] = best[1:]
            at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = rate * gs / (hs + penalty)
        score += value[leaf]
        made.append(Tree(feature, cut, value))
    return Model(base, made)
