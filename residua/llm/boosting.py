"""Gradient-boosted trees on binned features, small enough to travel with a job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

BINS = 32
# gradients are summed as whole numbers of this part, so that sums do not depend on the order of rows or blocks
UNIT = float(1 << 30)


def cuts_of(quantiles: Sequence[float]) -> np.ndarray:
    """Borders between the bins of a feature, from its ``BINS`` evenly spaced quantiles."""
    return np.unique(np.asarray(quantiles, float))[:-1]


def bins_of(cuts: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The bin of each feature of each row: how many cuts lie below it."""
    return np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], 1).astype(np.uint8)


def tree_nodes(features: np.ndarray, borders: np.ndarray, x: np.ndarray, levels: int) -> np.ndarray:
    """The node, counted from the root, that each row reaches after some levels."""
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, features[node]] > borders[node])
    return node


def gradient_sums(binned: np.ndarray, positive: np.ndarray, count: np.ndarray, start: float, trees: list[tuple],
                  features: np.ndarray, borders: np.ndarray, level: int) -> np.ndarray:
    """Whole sums of gradients and curvatures by node of a level, feature and bin.

    A row stands for ``count`` rows, of which ``positive`` are true; borders are bins.
    """
    score = np.full(len(binned), start)
    for own_features, own_borders, leaves in trees:
        depth = len(leaves).bit_length() - 1
        score += leaves[tree_nodes(own_features, own_borders, binned, depth) - len(own_features)]
    p = 1 / (1 + np.exp(-score))
    sides = [np.rint((p * count - positive) * UNIT), np.rint(p * (1 - p) * count * UNIT)]
    node, nodes = tree_nodes(features, borders, binned, level) - ((1 << level) - 1), 1 << level
    out = np.zeros((2, nodes, binned.shape[1], BINS + 1), np.int64)
    for f in range(binned.shape[1]):
        slot = node * (BINS + 1) + binned[:, f]
        for side, values in zip(out, sides):
            side[:, f] = np.rint(np.bincount(slot, values, nodes * (BINS + 1))).reshape(nodes, -1)
    return out


class Boosted:
    """Trees of fixed depth under the logistic loss; each split looks at histograms of gradients."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.l2, self.least = rounds, depth, rate, l2, least
        self.cuts: list[np.ndarray] = []
        self.features = np.zeros((0, 0), np.int64)
        self.borders = np.zeros((0, 0))
        self.leaves = np.zeros((0, 0))
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [cuts_of(np.quantile(column, np.linspace(0, 1, BINS))) for column in x.T]
        binned, ones = bins_of(cuts, x), np.ones(len(y))
        return self.fit_sums(cuts, float(y.mean()), lambda *at: gradient_sums(binned, y, ones, *at))

    def fit_sums(self, cuts: list[np.ndarray], share: float, sums: Callable[..., np.ndarray]) -> Boosted:
        """Fit on rows that stay where they are: ``sums`` gives what :func:`gradient_sums` gives over all of them."""
        self.cuts = cuts
        share = min(max(share, 1e-4), 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        inner = (1 << self.depth) - 1
        trees: list[tuple] = []
        for _ in range(self.rounds):
            features, borders = np.zeros(inner, np.int64), np.full(inner, BINS)
            for level in range(self.depth):
                base, nodes = (1 << level) - 1, 1 << level
                gs, hs = (side.cumsum(2) / UNIT for side in sums(self.start, trees, features, borders, level))
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs)**2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                for i in range(nodes):
                    f, b = divmod(int(gain[i].argmax()), BINS + 1)
                    if gain[i, f, b] > 1e-9:
                        features[base + i], borders[base + i] = f, b
            # the last histograms hold the sums of both sides of each last split
            last = np.arange(nodes)
            f, b = features[base + last], borders[base + last]
            halves = [np.stack([side[last, f, b], side[last, f, -1] - side[last, f, b]], 1).ravel() for side in (gs, hs)]
            trees.append((features, borders, -self.rate * halves[0] / (halves[1] + self.l2)))
        self.features = np.array([t[0] for t in trees])
        self.borders = np.array([[cuts[f][b] if b < len(cuts[f]) else np.inf for f, b in zip(*t[:2])] for t in trees])
        self.leaves = np.array([t[2] for t in trees])
        return self


def boosted_scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of the rows of ``x`` under the fields of a fitted model."""
    score = np.full(len(x), model["start"])
    rows = np.arange(len(x))
    for features, borders, leaves in zip(model["features"], model["borders"], model["leaves"]):
        node = np.zeros(len(x), np.int64)
        while len(x) and node[0] < len(features):
            node = 2 * node + 1 + (x[rows, features[node]] > borders[node])
        score += leaves[node - len(features)]
    return 1 / (1 + np.exp(-score))
