"""Gradient-boosted trees for a binary label, and isotonic calibration, in numpy.

Made for a bounded sample of dense features on the driver: histogram splits of
at most 64 bins, trees of fixed depth, logistic loss, weighted rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """feature and threshold of inner nodes (heap order), values of leaves."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, penalty: float = 2.0) -> Trees:
    """Boosted trees of the rows x with labels y (0 or 1)."""
    n, m = x.shape
    share = np.clip((weight * y).sum() / max(weight.sum(), 1e-12), 1e-4, 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(1) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1) if n else np.zeros((0, m), np.int64)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    margin = np.full(n, start)
    for _ in range(rounds if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            local = node - base
            best_gain, best = np.full(width, 1e-9), [(0, np.inf, BINS)] * width
            tot_g, tot_h = np.bincount(local, g, width), np.bincount(local, h, width)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                k = len(cuts[j]) + 1
                at = local * k + binned[:, j]
                left_g = np.bincount(at, g, width * k).reshape(width, k).cumsum(axis=1)[:, :-1]
                left_h = np.bincount(at, h, width * k).reshape(width, k).cumsum(axis=1)[:, :-1]
                right_g, right_h = tot_g[:, None] - left_g, tot_h[:, None] - left_h
                gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - (tot_g**2 / (tot_h + penalty))[:, None]
                gain[(left_h < 1e-3) | (right_h < 1e-3)] = 0
                top = gain.argmax(axis=1)
                for w in np.flatnonzero(gain[np.arange(width), top] > best_gain):
                    best_gain[w], best[w] = gain[w, top[w]], (j, float(cuts[j][top[w]]), int(top[w]))
            for w, (j, t, _) in enumerate(best):
                feature[base + w], threshold[base + w] = j, t
            split_feature = np.array([b[0] for b in best])[local]
            split_bin = np.array([b[2] for b in best])[local]
            node = 2 * node + 1 + (binned[np.arange(n), split_feature] > split_bin)
        local = node - inner
        leaf = -rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + penalty)
        margin += leaf[local]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Trees(start, np.array(features).reshape(-1, inner), np.array(thresholds).reshape(-1, inner), np.array(values).reshape(-1, leaves))


@dataclass
class Isotonic:
    """A rising piecewise linear map from raw scores to probabilities."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return 1 / (1 + np.exp(-raw))
        return np.clip(np.interp(raw, self.at, self.value), 0.0, 1.0)


def calibrate(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
    """Pool adjacent violators; without both labels, the logistic map."""
    if not len(raw) or y.min() == y.max():
        return Isotonic(np.zeros(0), np.zeros(0))
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weighted label, weight, weighted score
    for r, label, w in zip(raw[order], y[order], weight[order]):
        blocks.append([w * label, w, w * r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return Isotonic(np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks]))
