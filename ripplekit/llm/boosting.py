"""Gradient-boosted trees in numpy: histogram training with monotone constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: node k has children 2k+1 and 2k+2; leaves follow."""

    depth: int
    base: float
    feature: np.ndarray  # (trees, 2**depth - 1) int
    threshold: np.ndarray  # same shape; x <= threshold goes left
    value: np.ndarray  # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic boosting. monotone: +1 (never falls), -1 (never rises) or 0 for every feature.

    A split on a constrained feature must order its two values, and bounds at their midpoint pass
    down, so that the sum of trees keeps the direction everywhere. Without two classes in ``y`` the
    result is a constant.
    """
    n, width = x.shape
    p = (y.sum() + 1) / (n + 2) if n else 0.5
    out = Trees(depth, float(np.log(p / (1 - p))), np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    if n == 0 or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    margin = np.full(n, out.base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        node, bound = np.zeros(n, np.int64), {0: (-np.inf, np.inf)}
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-6)
            pick: list = [None] * count
            for k in range(width):
                size = len(cuts[k]) + 1
                if size < 2:
                    continue
                key = local * size + binned[:, k]
                gl = np.bincount(key, g, count * size).reshape(count, size).cumsum(1)
                hl = np.bincount(key, h, count * size).reshape(count, size).cumsum(1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gl, hl = gl[:, :-1], hl[:, :-1]
                lo = np.array([bound[first + i][0] for i in range(count)])[:, None]
                hi = np.array([bound[first + i][1] for i in range(count)])[:, None]
                wl, wr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(ga - gl) / (ha - hl + l2), lo, hi)
                whole = np.clip(-ga / (ha + l2), lo, hi)
                gain = lambda w, a, b: -(a * w + 0.5 * (b + l2) * w * w)
                won = gain(wl, gl, hl) + gain(wr, ga - gl, ha - hl) - gain(whole, ga, ha)
                won[(hl < least) | (ha - hl < least) | (monotone[k] * (wr - wl) < 0)] = -np.inf
                top = won.argmax(1)
                for i in range(count):
                    if won[i, top[i]] > best[i]:
                        best[i], pick[i] = won[i, top[i]], (k, top[i], wl[i, top[i]], wr[i, top[i]])
            for i in range(count):
                at, (lo, hi) = first + i, bound[first + i]
                left = right = (lo, hi)
                if pick[i] is not None:
                    k, b, wl, wr = pick[i]
                    out.feature[t, at], out.threshold[t, at] = k, cuts[k][b]
                    mid = (wl + wr) / 2
                    if monotone[k] > 0:
                        left, right = (lo, min(hi, mid)), (max(lo, mid), hi)
                    elif monotone[k] < 0:
                        left, right = (max(lo, mid), hi), (lo, min(hi, mid))
                bound[2 * at + 1], bound[2 * at + 2] = left, right
            f, thr = out.feature[t][node], out.threshold[t][node]
            node = 2 * node + 1 + (x[np.arange(n), f] > thr)
        leaf = node - (2**depth - 1)
        gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        lo, hi = np.array([bound[2**depth - 1 + i] for i in range(2**depth)]).T
        out.value[t] = rate * np.clip(-gs / (hs + l2), lo, hi)
        margin += out.value[t][leaf]
    return out
