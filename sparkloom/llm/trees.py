"""Small learners in numpy: boosted histogram trees and isotonic regression."""

from __future__ import annotations

import numpy as np


def quantile_bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Cut points per feature; value v falls into bin searchsorted(cuts, v, 'right')."""
    cuts = []
    for j in range(x.shape[1]):
        seen = np.unique(x[:, j])
        if len(seen) > most:
            seen = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most), method="lower"))
            whole = np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, 5), method="lower"))
            seen = np.unique(np.concatenate([seen, whole]))
        cuts.append((seen[1:] + seen[:-1]) / 2)
    return cuts


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    if not len(cuts):
        return np.zeros((len(x), 0), dtype=np.int64)
    return np.column_stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)])


class Boosted:
    """A sum of complete trees, each a (feature, cut) per inner node and a value per leaf."""

    def __init__(self, base: float, cuts: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.base, self.cuts, self.trees = base, cuts, trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.cuts)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def _best_split(b: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, least: float, ridge: float):
    """(gain, feature, bin) of the best split of these rows; gain 0 if there is none."""
    best = (1e-6, 0, bins)
    total_g, total_h = g.sum(), h.sum()
    base = total_g**2 / (total_h + ridge)
    for j in range(b.shape[1]):
        left_g = np.cumsum(np.bincount(b[:, j], g, bins))[:-1]
        left_h = np.cumsum(np.bincount(b[:, j], h, bins))[:-1]
        ok = (left_h >= least) & (total_h - left_h >= least)
        gain = np.where(
            ok, left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - base, 0
        )
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    return best


def fit_boosted(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.1, most_bins: int = 48, least: float = 2.0, ridge: float = 2.0
) -> Boosted:
    """Logistic boosting with complete trees of ``depth`` levels."""
    cuts = quantile_bins(x, most_bins)
    b = binned(x, cuts)
    bins = 1 + max((len(c) for c in cuts), default=0)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    f = np.full(len(y), base)
    trees = []
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, bins, dtype=np.int64)
        members = [np.arange(len(y))] + [None] * (2 ** (depth + 1) - 2)
        for node in range(inner):
            rows = members[node]
            if len(rows) > 1:
                _, feature[node], cut[node] = _best_split(b[rows], g[rows], h[rows], bins, least, ridge)
            right = b[rows, feature[node]] > cut[node]
            members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
        leaf = np.zeros(inner + 1)
        for k in range(inner + 1):
            rows = members[inner + k]
            leaf[k] = rate * g[rows].sum() / (h[rows].sum() + ridge)
            f[rows] += leaf[k]
        trees.append((feature, cut, leaf))
    return Boosted(base, cuts, trees)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a non-decreasing map from score to probability (pool adjacent violators)."""
    at, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    value = np.bincount(inverse, y) / weight
    blocks: list[list[float]] = []
    for a, v, w in zip(at, value, weight, strict=True):
        blocks.append([a, a, v, w])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            lo, hi = blocks[-2], blocks.pop()
            w2 = lo[3] + hi[3]
            blocks[-1] = [lo[0], hi[1], (lo[2] * lo[3] + hi[2] * hi[3]) / w2, w2]
    xs, ys = [], []
    for lo, hi, v, _ in blocks:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [v, v] if hi > lo else [v]
    return np.array(xs), np.array(ys)
