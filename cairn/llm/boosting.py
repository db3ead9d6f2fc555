"""Gradient-boosted regression trees on binned features, for the logistic loss; trained and applied in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Complete trees of one depth: arrays of split features, thresholds and leaf values."""

    def __init__(self, depth: int, base: float) -> None:
        self.depth, self.base = depth, base
        self.feature: np.ndarray = np.zeros((0, 2**depth - 1), np.int32)
        self.threshold: np.ndarray = np.zeros((0, 2**depth - 1), np.float32)
        self.leaf: np.ndarray = np.zeros((0, 2**depth), np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.base, np.float64), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    # all features' bins side by side: one count serves every feature
    widths = np.array([len(e) + 1 for e in edges])
    opens = np.cumsum(widths) - widths
    binned = np.stack([np.searchsorted(e, x[:, f], "left") + opens[f] for f, e in enumerate(edges)], 1)
    total, of = int(widths.sum()), np.repeat(np.arange(len(edges)), widths)
    is_split = np.arange(total) != (opens + widths - 1)[of]  # behind a feature's last bin there is nothing to split off
    split_at = np.concatenate([np.append(e, np.inf) for e in edges]).astype(np.float32)
    share = float((y * weight).sum() / weight.sum())
    model = Boosted(depth, float(np.log(share / (1 - share))))
    margin = np.full(len(y), model.base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        g_all, h_all = np.repeat(g, len(edges)), np.repeat(h, len(edges))
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf, np.float32)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * total + binned).ravel()
            gs, hs = (np.bincount(key, v, count * total).reshape(count, total).cumsum(1) for v in (g_all, h_all))
            # sums inside a feature: less what stood before its first bin
            gs, hs = (s - np.concatenate([np.zeros((count, 1)), s], 1)[:, opens][:, of] for s in (gs, hs))
            gt, ht = (s[:, (opens + widths - 1)][:, of] for s in (gs, hs))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain = np.where(is_split, gain, -np.inf)
            at = gain.argmax(1)
            better = gain[np.arange(count), at] > 1e-9
            feature[first : first + count][better] = of[at[better]]
            threshold[first : first + count][better] = split_at[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        local = node - (2**depth - 1)
        leaf = rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + ridge)
        margin += leaf[local]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf.astype(np.float32))
    model.feature, model.threshold, model.leaf = np.stack(features), np.stack(thresholds), np.stack(leaves)
    return model
