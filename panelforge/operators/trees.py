"""Regression trees over rows at hand: forests and boosted trees as ``pyspark.ml`` grows
them, and symmetric trees as :func:`panelforge.operators.regress.fit_oblivious` does.

Trees grow level by level, all trees of a forest side by side, from sums of the label by
(node, feature, bin).  Features are cut into at most ``BINS`` bins: midpoints of distinct
values if these are few, else about equally many rows a bin.  A split must leave ``least``
rows (counted as often as drawn) on each side; of equal gains the first feature and cut wins.  Each tree
draws from a generator of its own, so a fit of n trees is the first n trees of a longer one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Bins of a feature (``maxBins`` of pyspark.ml).
BINS = 32
#: Cells of (node, feature, bin), and entries of (tree, row, feature), held at a time.
CELLS = 1 << 21
#: Gains within this share of a node's sum of squares are equal.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees, the roots first; a leaf has feature -1.  ``cut`` is a threshold, or a bin while fitting:
    a row goes left if its value is at most that."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf value of each row in each tree (trees x rows)."""
        at = np.repeat(np.arange(len(self.weight))[:, None], len(x), axis=1)
        rows = np.broadcast_to(np.arange(len(x)), at.shape)
        while (inner := self.feature[at] >= 0).any():
            node = at[inner]
            right = x[rows[inner], self.feature[node]] > self.cut[node]
            at[inner] = np.where(right, self.right[node], self.left[node])
        return self.value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        step = max(1, CELLS // max(1, len(self.weight)))
        for lo in range(0, len(x), step):
            out[lo:lo + step] = self.weight @ self.leaves(x[lo:lo + step])
        return out

    def with_thresholds(self, cuts: Sequence[np.ndarray]) -> Trees:
        """The same trees with thresholds in place of bins."""
        found = [cuts[f][int(b)] if f >= 0 else 0.0 for f, b in zip(self.feature, self.cut)]
        return Trees(self.feature, np.array(found, float), self.left, self.right, self.value, self.weight)


def joined(parts: Sequence[Trees]) -> Trees:
    """One ensemble of all trees of ``parts``, in that order."""
    if len(parts) == 1:
        return parts[0]
    roots = np.cumsum([0, *(len(p.weight) for p in parts)])
    inner = roots[-1] + np.cumsum([0, *(len(p.feature) - len(p.weight) for p in parts)])
    order: list = [[], []]
    moved = []
    for i, p in enumerate(parts):
        t = len(p.weight)
        to = np.concatenate([roots[i] + np.arange(t), inner[i] + np.arange(len(p.feature) - t)])
        order[0].append(to[:t])
        order[1].append(to[t:])
        moved.append((np.where(p.feature >= 0, to[p.left], 0), np.where(p.feature >= 0, to[p.right], 0)))

    def stacked(arrays):
        return np.concatenate([a[:len(p.weight)] for a, p in zip(arrays, parts)] + [a[len(p.weight):] for a, p in zip(arrays, parts)])

    return Trees(stacked([p.feature for p in parts]), stacked([p.cut for p in parts]), stacked([m[0] for m in moved]),
                 stacked([m[1] for m in moved]), stacked([p.value for p in parts]), np.concatenate([p.weight for p in parts]))


# --------------------------------------------------------------------- bins
def thresholds(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Split candidates of each column, as ``pyspark.ml`` finds them on rows it does not sample."""
    out = []
    most = min(bins, len(x)) - 1
    for column in x.T:
        values, counts = np.unique(column, return_counts=True)
        middle = (values[:-1] + values[1:]) / 2
        if len(middle) > most:
            stride = len(column) / (most + 1)
            seen, goal, keep = np.cumsum(counts).tolist(), stride, []
            for i in range(1, len(values)):
                if abs(seen[i - 1] - goal) < abs(seen[i] - goal):
                    keep.append(i - 1)
                    goal += stride
            middle = middle[keep]
        out.append(middle)
    return out


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The number of cuts below each value."""
    return np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)])


# ------------------------------------------------------------------ growing
def _allowed(owner: np.ndarray, p: int, chosen: int, draws: Sequence[np.random.Generator]) -> np.ndarray:
    """``chosen`` features of each node, drawn by the node's tree."""
    if chosen >= p:
        return np.ones((len(owner), p), bool)
    trees, counts = np.unique(owner, return_counts=True)
    keys = np.concatenate([draws[t].random((c, p)) for t, c in zip(trees, counts)])
    out = np.zeros(keys.shape, bool)
    np.put_along_axis(out, np.argpartition(keys, chosen - 1, axis=1)[:, :chosen], True, axis=1)
    return out


def _best(bins, slot, row, weight, wy, noise, allowed, n_cuts, least):
    """Feature (-1: none) and bin of the split that lessens the squared error of each node most."""
    k, p = allowed.shape
    width = int(n_cuts.max()) + 1
    feature, at = np.full(k, -1), np.zeros(k, int)
    per = max(1, CELLS // (p * width))
    real = np.arange(width - 1) < n_cuts[:, None]
    for lo in range(0, k if width > 1 else 0, per):
        hi = min(k, lo + per)
        e = slice(None) if per >= k else np.flatnonzero((slot >= lo) & (slot < hi))
        cell = (((slot[e] - lo)[:, None] * p + np.arange(p)) * width + bins[row[e]]).ravel()
        shape = (hi - lo, p, width)
        n = np.bincount(cell, np.repeat(weight[e], p), np.prod(shape)).reshape(shape).cumsum(axis=2)
        g = np.bincount(cell, np.repeat(wy[e], p), np.prod(shape)).reshape(shape).cumsum(axis=2)
        nl, gl, n, g = n[:, :, :-1], g[:, :, :-1], n[:, :, -1:], g[:, :, -1:]
        ok = (nl >= least) & (n - nl >= least) & real & allowed[lo:hi, :, None]
        gain = np.where(ok, gl ** 2 / np.where(ok, nl, 1.0) + (g - gl) ** 2 / np.where(ok, n - nl, 1.0) - g ** 2 / np.maximum(n, 1e-300), -np.inf)
        gain = gain.reshape(hi - lo, -1)
        most = gain.max(axis=1)
        first = (gain >= (most - noise[lo:hi])[:, None]).argmax(axis=1)
        take = np.flatnonzero(most > noise[lo:hi])
        feature[lo + take], at[lo + take] = first[take] // (width - 1), first[take] % (width - 1)
    return feature, at


def grow(bins: np.ndarray, n_cuts: np.ndarray, y: np.ndarray, counts: np.ndarray, depth: int, least: int,
         chosen: int, draws: Sequence[np.random.Generator]) -> Trees:
    """A tree for each row of ``counts`` (how often the tree has each row), cut at bins, of weight 1."""
    center = y.mean()
    y = y - center
    tree, row = np.nonzero(counts)
    weight = counts[tree, row].astype(float)
    slot, owner, made, levels = tree, np.arange(len(counts)), len(counts), []
    for level in range(depth + 1):
        k = len(owner)
        wy = weight * y[row]
        n, g = np.bincount(slot, weight, k), np.bincount(slot, wy, k)
        feature, at = np.full(k, -1), np.zeros(k, int)
        if level < depth:
            noise = ROUNDING * np.bincount(slot, wy * y[row], k)
            feature, at = _best(bins, slot, row, weight, wy, noise, _allowed(owner, bins.shape[1], chosen, draws), n_cuts, least)
        split = feature >= 0
        place = np.cumsum(split) - 1
        left = np.where(split, made + 2 * place, 0)
        levels.append((feature, at, left, np.where(split, left + 1, 0), center + g / np.maximum(n, 1.0)))
        if not split.any():
            break
        made += 2 * int(split.sum())
        inside = split[slot]
        slot, row, weight = slot[inside], row[inside], weight[inside]
        slot = 2 * place[slot] + (bins[row, feature[slot]] > at[slot])
        owner = np.repeat(owner[split], 2)
    return Trees(*(np.concatenate(a) for a in zip(*levels)), np.ones(len(counts)))


def forest(x: np.ndarray, y: np.ndarray, n_trees: int, depth: int, least: int, chosen: int, seed: int) -> Trees:
    """Trees of ``n_trees`` bootstrap draws of the rows (Poisson counts), their mean the prediction."""
    cuts = thresholds(x)
    bins, n_cuts = binned(x, cuts), np.array([len(c) for c in cuts])
    parts, step = [], max(1, CELLS // (8 * x.size))
    for lo in range(0, n_trees, step):
        draws = [np.random.default_rng([seed, t]) for t in range(lo, min(n_trees, lo + step))]
        counts = np.stack([r.poisson(1.0, len(y)) for r in draws])
        parts.append(grow(bins, n_cuts, y, counts, depth, least, chosen, draws))
    found = joined(parts).with_thresholds(cuts)
    return Trees(found.feature, found.cut, found.left, found.right, found.value, np.full(n_trees, 1.0 / n_trees))


def boosted(x: np.ndarray, y: np.ndarray, n_trees: int, depth: int, rate: float, subsample: float, chosen: int, seed: int) -> Trees:
    """Gradient boosting for squared error as ``GBTRegressor`` does it: the first tree on the label at weight 1, each
    later one on twice the residuals at weight ``rate``; a tree reads ``subsample`` of the rows, drawn anew."""
    cuts = thresholds(x)
    bins, n_cuts = binned(x, cuts), np.array([len(c) for c in cuts])
    parts, now = [], np.zeros(len(y))
    for t in range(n_trees):
        draw = np.random.default_rng([seed, t])
        counts = np.ones((1, len(y)), int) if subsample >= 1 else (draw.random((1, len(y))) < subsample).astype(int)
        tree = grow(bins, n_cuts, y if t == 0 else 2 * (y - now), counts, depth, 1, chosen, [draw])
        now = now + (rate if t else 1.0) * tree.leaves(bins)[0]
        parts.append(tree)
    found = joined(parts).with_thresholds(cuts)
    return Trees(found.feature, found.cut, found.left, found.right, found.value, np.array([rate if t else 1.0 for t in range(n_trees)]))


# ---------------------------------------------------------- symmetric trees
def quantile_borders(x: np.ndarray, null: np.ndarray, n: int) -> list[list[float]]:
    """The distinct k/n quantiles of each column, NULLs left out."""
    out = []
    for column, skip in zip(x.T, null.T):
        values = np.sort(column[~skip])
        ranks = np.ceil(np.arange(1, n) / n * len(values)).astype(int)
        out.append(sorted(set(values[np.maximum(ranks, 1) - 1].tolist())) if len(values) else [])
    return out


def border_bins(x: np.ndarray, null: np.ndarray, borders: Sequence[Sequence[float]]) -> np.ndarray:
    """The number of borders below each value; 0 for a NULL, a NaN is above all."""
    return np.where(null, 0, binned(x, [np.array(b) for b in borders]))


def symmetric(bins: np.ndarray, n_cuts: np.ndarray, y: np.ndarray, n_trees: int, depth: int, rate: float, lam: float) -> tuple[float, list]:
    """The mean label and the trees, each as [(feature, border)] by level and its leaf values: every level takes the split that
    has most Σ G²/(n + λ) over its leaves; leaf values are rate · G / (n + λ)."""
    rows, p = bins.shape
    width = int(n_cuts.max(initial=0)) + 1
    base = float(y.mean())
    trees: list = []
    if width == 1:
        return base, trees
    real = np.arange(width - 1) < n_cuts[:, None]
    columns, now = np.arange(p), np.full(rows, base)
    per_row = lambda n, g: np.where(n + lam > 0, g ** 2 / np.where(n + lam > 0, n + lam, 1.0), 0.0)
    for _ in range(n_trees):
        g, leaf, splits = y - now, np.zeros(rows, int), []
        wg = np.repeat(g, p)
        for level in range(depth):
            shape = (2 ** level, p, width)
            cell = ((leaf[:, None] * p + columns) * width + bins).ravel()
            ns = np.bincount(cell, None, np.prod(shape)).reshape(shape).cumsum(axis=2)
            gs = np.bincount(cell, wg, np.prod(shape)).reshape(shape).cumsum(axis=2)
            nl, gl = ns[:, :, :-1], gs[:, :, :-1]
            gains = (per_row(nl, gl) + per_row(ns[:, :, -1:] - nl, gs[:, :, -1:] - gl)).sum(axis=0)
            gains = np.where(real, gains, -np.inf).ravel()
            f, t = divmod(int((gains >= gains.max() * (1 - ROUNDING)).argmax()), width - 1)
            splits.append((f, t))
            leaf = leaf * 2 + (bins[:, f] > t)
        n, total = np.bincount(leaf, None, 2 ** depth), np.bincount(leaf, g, 2 ** depth)
        values = np.where(n > 0, rate * total / np.where(n > 0, n + lam, 1.0), 0.0)
        now = now + values[leaf]
        trees.append((splits, values.tolist()))
    return base, trees


def symmetric_leaves(bins: np.ndarray, trees: Sequence) -> np.ndarray:
    """The leaf value of each row in each symmetric tree (trees x rows)."""
    out = np.zeros((len(trees), len(bins)))
    for i, (splits, values) in enumerate(trees):
        leaf = np.zeros(len(bins), int)
        for f, t in splits:
            leaf = leaf * 2 + (bins[:, f] > t)
        out[i] = np.array(values)[leaf]
    return out
