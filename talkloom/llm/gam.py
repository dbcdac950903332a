"""Generalised additive model with pairwise interactions, boosted in cycles.

Every feature is cut into bins. Cycle after cycle, each feature in turn gets a shallow tree fitted to
the current gradient over its bins; trees of a feature add up to one lookup table. The pairs with the
largest remaining gain get tables over their coarse bins in the same way. A score is the sum of one table entry per feature and
pair, through the logistic function.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS, COARSE = 64, 8


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, features: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, features[:, f], "right") for f, e in enumerate(self.edges)]

    def score(self, features: np.ndarray) -> np.ndarray:
        bins = self.bins(features)
        total = np.full(len(features), self.start)
        for f, table in enumerate(self.tables):
            total += table[bins[f]]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[_coarse(bins[f]), _coarse(bins[g])]
        return sigmoid(total)


def _coarse(bins: np.ndarray) -> np.ndarray:
    return bins * COARSE // BINS


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best cut of ordered bins: (gain, first bin of the right side)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (0.0, len(g))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree over ordered bins, as the value of every bin."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        cuts = [(*_split(g[a:b], h[a:b], ridge), a, b) for a, b in spans if b - a > 1]
        if not cuts or max(cuts)[0] <= 1e-9:
            break
        _, at, a, b = max(cuts)
        spans.remove((a, b))
        spans += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """One cut of the first feature, then one of the second on either side."""
    _, at = _split(g.sum(1), h.sum(1), ridge)
    out = np.zeros_like(g)
    for rows in (slice(0, at), slice(at, len(g))):
        out[rows] = _tree(g[rows].sum(0), h[rows].sum(0), 2, ridge)[None, :]
    return out


def fit(features: np.ndarray, labels: np.ndarray, *, cycles: int = 100, pair_cycles: int = 30, pairs: int = 6,
        rate: float = 0.15, leaves: int = 3, ridge: float = 2.0) -> Model:
    """Deterministic for given rows. Without both labels the model is the smoothed share of label 1."""
    y = labels.astype(float)
    n, width = len(y), features.shape[1]
    share = (y.sum() + 1) / (n + 2)
    model = Model(float(np.log(share / (1 - share))), [], [np.zeros(BINS) for _ in range(width)])
    for f in range(width):
        cuts = np.unique(np.quantile(features[:, f], np.arange(1, BINS) / BINS)) if n else np.zeros(0)
        model.edges.append(cuts[: BINS - 1])
    if len(np.unique(y)) < 2:
        return model
    bins = model.bins(features)
    total = np.full(n, model.start)
    for _ in range(cycles):
        for f in range(width):
            p = sigmoid(total)
            step = rate * _tree(np.bincount(bins[f], y - p, BINS), np.bincount(bins[f], p * (1 - p), BINS), leaves, ridge)
            model.tables[f] += step
            total += step[bins[f]]
    cells = [_coarse(b) for b in bins]
    p = sigmoid(total)

    def grid(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        at = cells[f] * COARSE + cells[g]
        return np.bincount(at, y - p, COARSE**2).reshape(COARSE, COARSE), np.bincount(at, p * (1 - p), COARSE**2).reshape(COARSE, COARSE)

    gains = []
    for f in range(width):
        for g in range(f + 1, width):
            a, b = grid(f, g)
            gains.append((float((a**2 / (b + ridge)).sum()), f, g))
    model.pairs = [(f, g) for _, f, g in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((COARSE, COARSE)) for _ in model.pairs]
    for _ in range(pair_cycles):
        for k, (f, g) in enumerate(model.pairs):
            p = sigmoid(total)
            step = rate * _pair_tree(*grid(f, g), ridge)
            model.pair_tables[k] += step
            total += step[cells[f], cells[g]]
    return model
