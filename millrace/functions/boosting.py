"""Boosted regression trees on binned features, for tables that one task holds.

Squared loss, leaf values shrunk by an L2 penalty, rows and columns sampled for each tree,
and an end when the validation error has not fallen for `patience` rounds. Larger tables
go through pyspark.ml (``operators.validation.boosted_folds``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Settings:
    rounds: int = 1500
    rate: float = 0.03
    depth: int = 5
    least_rows: int = 20
    l2: float = 10.0
    rows: float = 0.8
    columns: float = 0.8
    patience: int = 50
    seed: int = 42


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Inner bin borders of each column: quantiles of its distinct values."""
    levels = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(np.unique(c), levels)) if len(c) else np.zeros(0) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.int64) if x.shape[1] else np.zeros((len(x), 0), np.int64)


@dataclass
class Tree:
    """Heap of nodes: split feature (-1: leaf), last bin that goes left, value."""

    feature: np.ndarray
    border: np.ndarray
    value: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(int(np.log2(len(self.value) + 1)) - 1):
            f = self.feature[at]
            right = bins[rows, np.maximum(f, 0)] > self.border[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return self.value[at]


def grow(bins: np.ndarray, residual: np.ndarray, columns: np.ndarray, s: Settings) -> Tree:
    size = 2 ** (s.depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
    at = np.zeros(len(bins), np.int64)
    for level in range(s.depth + 1):
        first, n = 2**level - 1, 2**level
        here = at >= first
        node = at[here] - first
        total, count = np.bincount(node, residual[here], n), np.bincount(node, minlength=n)
        tree.value[first : first + n] = np.where(count > 0, total / (count + s.l2), 0.0)
        if level == s.depth:
            break
        gain, choice, border = np.full(n, 1e-12), np.full(n, -1), np.zeros(n, np.int64)
        for f in columns:
            cell = node * BINS + bins[here, f]
            left = np.cumsum(np.bincount(cell, residual[here], n * BINS).reshape(n, BINS), axis=1)
            held = np.cumsum(np.bincount(cell, minlength=n * BINS).reshape(n, BINS), axis=1)
            other, rest = total[:, None] - left, count[:, None] - held
            better = left**2 / (held + s.l2) + other**2 / (rest + s.l2) - (total**2 / (count + s.l2))[:, None]
            better[(held < s.least_rows) | (rest < s.least_rows)] = 0
            best = better.argmax(axis=1)
            high = better[np.arange(n), best]
            new = high > gain
            gain[new], choice[new], border[new] = high[new], f, best[new]
        tree.feature[first : first + n], tree.border[first : first + n] = choice, border
        split = choice[node] >= 0
        rows = np.flatnonzero(here)[split]
        f = choice[node[split]]
        at[rows] = 2 * at[rows] + 1 + (bins[rows, f] > border[node[split]])
        if not len(rows):
            break
    return tree


def boosted(x: np.ndarray, y: np.ndarray, x_valid: np.ndarray, y_valid: np.ndarray, x_test: np.ndarray, settings: Settings = Settings()) -> tuple[np.ndarray, int]:  # noqa: B008
    """Predictions for x_test by the trees up to the best validation error, and the number of the last of them (from 0)."""
    random = np.random.default_rng(settings.seed)
    cuts = cuts_of(x)
    train, valid, test = (binned(v, cuts) for v in (x, x_valid, x_test))
    base = float(y.mean())
    now, checked, out = (np.full(len(v), base) for v in (train, valid, test))
    best, best_round, best_out = np.inf, 0, out.copy()
    for i in range(settings.rounds):
        rows = np.flatnonzero(random.random(len(y)) < settings.rows)
        columns = np.sort(random.permutation(x.shape[1])[: max(1, round(settings.columns * x.shape[1]))])
        tree = grow(train[rows], (y - now)[rows], columns, settings)
        now += settings.rate * tree.predict(train)
        checked += settings.rate * tree.predict(valid)
        out += settings.rate * tree.predict(test)
        error = float(np.mean((y_valid - checked) ** 2))
        if error < best:
            best, best_round, best_out = error, i, out.copy()
        elif i - best_round >= settings.patience:
            break
    return best_out, best_round
