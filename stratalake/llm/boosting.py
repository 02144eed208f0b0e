"""Gradient-boosted trees for the logistic loss over binned dense features, and isotonic calibration; numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of equal depth as arrays: feature and threshold of inner nodes, values of leaves."""

    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting; splits by the gain over histograms of quantile bins; nodes without gain send all rows left."""
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) if n else np.zeros(0) for j in range(m)]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, m), np.int64)
    base = float(np.log(share / (1 - share)))
    z = np.full(n, base)
    inner = 2**depth - 1
    features, thresholds, leaves = [], [], []
    flat = np.arange(m) * BINS
    for _ in range(trees):
        p = sigmoid(z)
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (m * BINS) + flat + bins).ravel()
            sg = np.bincount(at, np.repeat(g, m), many * m * BINS).reshape(many, m, BINS).cumsum(2)
            sh = np.bincount(at, np.repeat(h, m), many * m * BINS).reshape(many, m, BINS).cumsum(2)
            tg, th = sg[:, :, -1:], sh[:, :, -1:]
            gain = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
            gain[(sh < least) | (th - sh < least)] = 0
            for k in range(many):
                j, b = divmod(int(gain[k].argmax()), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        sg, sh = np.bincount(node - inner, g, 2**depth), np.bincount(node - inner, h, 2**depth)
        leaf = rate * sg / (sh + ridge)
        z += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.array(features).reshape(-1, inner), np.array(thresholds).reshape(-1, inner), np.array(leaves).reshape(-1, 2**depth))


def isotonic(z: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (knots, values), values rising; equal scores are one point.

    ``weight`` pseudo-rows of the overall rate at each end keep values away from 0 and 1.
    """
    if not len(z):
        return np.array([0.0]), np.array([0.5])
    at, inverse = np.unique(z, return_inverse=True)
    n = np.bincount(inverse).astype(float)
    s = np.bincount(inverse, y)
    rate = y.mean()
    n[[0, -1]] += weight / 2
    s[[0, -1]] += weight / 2 * rate
    blocks: list[list[float]] = []  # sum, count, first knot, last knot
    for k, c, v in zip(at, n, s):
        blocks.append([v, c, k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v, c, _, last = blocks.pop()
            blocks[-1][0] += v
            blocks[-1][1] += c
            blocks[-1][3] = last
    knots = np.array([x for b in blocks for x in ((b[2],) if b[2] == b[3] else (b[2], b[3]))])
    values = np.array([b[0] / b[1] for b in blocks for _ in range(1 if b[2] == b[3] else 2)])
    return knots, values
