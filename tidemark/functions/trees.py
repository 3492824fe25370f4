"""Regression trees grown level by level on binned predictors, all nodes of a level and many trees at once.

Predictors are cut at ``BINS`` quantiles of the training rows; a level needs one histogram of label sums per (tree, node, predictor,
bin) and one pass over the rows.  A missing predictor stands below every value.  Trees are complete binary arrays: node i has
the children 2 i + 1 and 2 i + 2, and a leaf has predictor -1.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

BINS = 32
# (tree, row) pairs grown together
PAIRS_AT_ONCE = 30_000
# (tree, row, predictor) entries of a histogram that are made at once
ENTRIES_AT_ONCE = 2_000_000


@dataclass
class Trees:
    """``predictor``, ``cut`` and ``value`` are (trees, nodes); a forecast is ``base`` + ``scale`` x the sum of leaf values."""

    predictor: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    importance: np.ndarray
    medians: np.ndarray
    base: float
    scale: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Forecasts for rows of float predictors, NaN being missing; with medians, those stand in for it."""
        if self.medians.size:
            x = np.where(np.isnan(x), self.medians, x)
        total = np.zeros(len(x))
        depth = int(np.log2(self.predictor.shape[1] + 1)) - 1
        rows = np.arange(len(x))
        for predictor, cut, value in zip(self.predictor, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                p = predictor[node]
                right = x[rows, p] > cut[node]  # false for NaN
                node = np.where(p < 0, node, 2 * node + 1 + right)
            total += value[node]
        return self.base + self.scale * total

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, p=self.predictor, c=self.cut, v=self.value, i=self.importance, m=self.medians, s=np.array([self.base, self.scale]))
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> "Trees":
        z = np.load(io.BytesIO(data))
        return Trees(z["p"], z["c"], z["v"], z["i"], z["m"], *map(float, z["s"]))


def edges_of(column: np.ndarray) -> np.ndarray:
    """Cut points of one predictor: midpoints of its values, thinned to quantiles where there are many."""
    seen = np.unique(column[~np.isnan(column)])
    if seen.size < 2:
        return np.empty(0)
    if seen.size > BINS - 2:
        present = np.sort(column[~np.isnan(column)])
        seen = np.unique(present[np.linspace(0, present.size - 1, BINS - 1).astype(int)])
    return (seen[1:] + seen[:-1]) / 2


def binned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (0 missing, then 1 up) and a (predictors, BINS) table of the cut above each code."""
    codes = np.zeros(x.shape, np.uint8)
    cuts = np.full((x.shape[1], BINS), np.inf)
    for j in range(x.shape[1]):
        edges = edges_of(x[:, j])
        codes[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(edges, x[:, j], side="left"))
        cuts[j, 0] = -np.inf
        cuts[j, 1 : 1 + edges.size] = edges
    return codes, cuts


def _best(count: np.ndarray, total: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """From histograms (nodes, predictors, bins): each node's best predictor, bin and gain, and its count and sum."""
    left_n, left_s = count.cumsum(-1), total.cumsum(-1)
    all_n, all_s = left_n[:, :1, -1:], left_s[:, :1, -1:]
    right_n, right_s = all_n - left_n, all_s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s * left_s / left_n + right_s * right_s / right_n - all_s * all_s / all_n
    gain[(left_n < least) | (right_n < least)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    place = flat.argmax(1)
    best = flat[np.arange(len(flat)), place]
    return place // gain.shape[2], place % gain.shape[2], best, all_n[:, 0, 0], all_s[:, 0, 0]


def grow(
    codes: np.ndarray, cuts: np.ndarray, weight: np.ndarray, label: np.ndarray, depth: int, least: int, tried: int,
    rng: np.random.Generator,
) -> tuple[np.ndarray, ...]:
    """Grow ``len(weight)`` trees together; ``weight`` and ``label`` are (trees, rows).

    Every node tries ``tried`` predictors drawn for it.  Returns predictor, cut, value (trees, nodes), the gain per predictor, and
    every row's leaf.
    """
    trees, n = weight.shape
    width = codes.shape[1]
    nodes = 2 ** (depth + 1) - 1
    predictor, cut, value = np.full((trees, nodes), -1, np.int8), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    gains = np.zeros((trees, width))
    tree, row = np.nonzero(weight)
    w, wy = weight[tree, row], (weight * label)[tree, row]
    at = np.zeros(len(tree), np.int64)  # number inside the level
    leaf = np.zeros((trees, n), np.int64)
    floor = 1e-12 * float((wy * wy).sum() + 1e-300)
    for level in range(depth + 1):
        here = 2**level
        slot = tree * here + at
        first = here - 1
        if level == depth:
            count = np.bincount(slot, w, trees * here).reshape(trees, here)
            total = np.bincount(slot, wy, trees * here).reshape(trees, here)
            with np.errstate(divide="ignore", invalid="ignore"):
                value[:, first:] = np.where(count > 0, total / count, 0.0)
            leaf[tree, row] = first + at
            break
        if tried < width:
            drawn = np.argpartition(rng.random((trees * here, width)), tried, axis=1)[:, :tried]
        else:
            drawn = np.broadcast_to(np.arange(width), (trees * here, width))
        size = trees * here * tried * BINS
        count, total = np.zeros((2, size))
        step = max(1, ENTRIES_AT_ONCE // tried)
        for begin in range(0, len(row), step):
            some = slice(begin, begin + step)
            picked = codes[row[some, None], drawn[slot[some]]] if tried < width else codes[row[some]]
            index = (((slot[some] * tried)[:, None] + np.arange(tried)) * BINS + picked).ravel()
            count += np.bincount(index, np.repeat(w[some], tried), size)
            total += np.bincount(index, np.repeat(wy[some], tried), size)
        count, total = (v.reshape(-1, tried, BINS) for v in (count, total))
        which, code, gain, all_n, all_s = _best(count, total, least)
        used = drawn[np.arange(len(drawn)), which]
        split = gain > floor
        with np.errstate(divide="ignore", invalid="ignore"):
            value[:, first : first + here] = np.where(all_n > 0, all_s / all_n, 0.0).reshape(trees, here)
        predictor[:, first : first + here] = np.where(split, used, -1).reshape(trees, here)
        cut[:, first : first + here] = cuts[used, code].reshape(trees, here)
        owner = np.repeat(np.arange(trees), here)
        np.add.at(gains, (owner[split], used[split]), gain[split])
        goes_on = split[slot]
        leaf[tree[~goes_on], row[~goes_on]] = first + at[~goes_on]
        tree, row, w, wy, at, slot = (v[goes_on] for v in (tree, row, w, wy, at, slot))
        at = 2 * at + (codes[row, used[slot]] > code[slot])
        if not len(tree):
            break
    return predictor, cut, value, gains, leaf


def _shares(gains: np.ndarray) -> np.ndarray:
    whole = gains.sum(1, keepdims=True)
    return np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).mean(0)


def random_forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, least: int, seed: int) -> Trees:
    """Bootstrap trees over a square root of the predictors per node, averaged.  ``x`` has no missing values."""
    rng = np.random.default_rng(seed)
    codes, cuts = binned(x)
    tried = max(1, int(np.sqrt(x.shape[1])))
    centre = float(y.mean())
    parts = []
    together = max(1, PAIRS_AT_ONCE // len(y))
    for begin in range(0, trees, together):
        some = min(together, trees - begin)
        weight = np.stack([np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)) for _ in range(some)]).astype(float)
        parts.append(grow(codes, cuts, weight, np.broadcast_to(y - centre, weight.shape), depth, least, tried, rng)[:4])
    predictor, cut, value, gains = (np.concatenate(p) for p in zip(*parts))
    return Trees(predictor, cut, value, _shares(gains), np.median(x, axis=0), centre, 1.0 / trees)


def gradient_boosting(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, least: int, rate: float, seed: int) -> Trees:
    """Trees on the residuals of those before, each shrunk by ``rate``."""
    rng = np.random.default_rng(seed)
    codes, cuts = binned(x)
    base = float(y.mean())
    residual, one = y - base, np.ones((1, len(y)))
    parts = []
    for _ in range(rounds):
        made = grow(codes, cuts, one, residual[None, :], depth, least, x.shape[1], rng)
        parts.append(made[:4])
        residual = residual - rate * made[2][0, made[4][0]]
    predictor, cut, value, gains = (np.concatenate(p) for p in zip(*parts))
    return Trees(predictor, cut, value, _shares(gains.sum(0, keepdims=True)), np.empty(0), base, rate)
