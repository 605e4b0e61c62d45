"""Gradient-boosted trees in numpy, with monotonic constraints, flattened into node arrays.

All trees have the same depth and are stored level by level, so a batch is scored with ``depth`` gathers per
tree and no branch.  Fitting bins every feature by quantiles and grows trees level by level from histograms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``feature`` and ``cut``: trees x inner nodes; ``leaf``: trees x leaves, values on the logit scale."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches; a value at or below the cut goes left."""
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (leaf.size - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    ridge: float = 1.0,
    least: int = 5,
) -> Trees:
    """Logistic boosting of y in {0, 1}; ``monotone`` has -1, 0 or 1 for each feature.

    A split is allowed only if its two leaf values keep the direction of its feature, and every later
    leaf below it stays within the bounds that the middle of the two values sets.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    offsets = np.arange(width) * bins
    rate_of_ones = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (width * bins) + offsets + binned).ravel()
            shape, size = (count, width, bins), count * width * bins
            g, h, c = (
                np.bincount(slot, weights=None if v is None else np.repeat(v, width), minlength=size).reshape(shape).cumsum(axis=2)
                for v in (gradient, hessian, None)
            )
            right_g, right_h, right_c = g[:, :, -1:] - g, h[:, :, -1:] - h, c[:, :, -1:] - c
            bound_low, bound_high = low[first : first + count, None, None], high[first : first + count, None, None]
            left = np.clip(g / (h + ridge), bound_low, bound_high)
            right = np.clip(right_g / (right_h + ridge), bound_low, bound_high)
            value = lambda v, a, b: v * a - 0.5 * (b + ridge) * v * v
            whole = np.clip(g[:, :, -1:] / (h[:, :, -1:] + ridge), bound_low, bound_high)
            gain = value(left, g, h) + value(right, right_g, right_h) - value(whole, g[:, :, -1:], h[:, :, -1:])
            wrong = (monotone[None, :, None] * (right - left)) < 0
            gain = np.where(wrong | (c < least) | (right_c < least), -np.inf, gain).reshape(count, -1)
            best = gain.argmax(axis=1)
            for k in range(count):
                at = first + k
                low[2 * at + 1 : 2 * at + 3], high[2 * at + 1 : 2 * at + 3] = low[at], high[at]
                f, b = divmod(int(best[k]), bins)
                if gain[k, best[k]] <= 1e-9 or b >= len(cuts[f]):
                    continue
                model.feature[t, at], model.cut[t, at] = f, cuts[f][b]
                if monotone[f]:
                    middle = (left[k, f, b] + right[k, f, b]) / 2
                    (high if monotone[f] > 0 else low)[2 * at + 1] = middle
                    (low if monotone[f] > 0 else high)[2 * at + 2] = middle
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t, node]] > model.cut[t, node])
        node -= inner
        g = np.bincount(node, weights=gradient, minlength=leaves)
        h = np.bincount(node, weights=hessian, minlength=leaves)
        model.leaf[t] = rate * np.clip(g / (h + ridge), low[inner:], high[inner:])
        score += model.leaf[t][node]
    return model
