"""Small forests and boosted trees: fitted on the driver over a bounded table of features, applied as SQL expressions.

A tree is nested tuples (feature, threshold, left, right) with numbers as leaves; a row goes left where its feature is
at most the threshold. As an expression it is nested IFs, so scoring stays in the JVM without Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple

#: Candidate thresholds of a feature in a node.
CUTS = 24


def grown(x: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: int, pick, leaf) -> Tree:
    """A regression tree by variance; pick() gives the features of a node, leaf(rows) a leaf's value."""

    def grow(rows: np.ndarray, depth: int) -> Tree:
        y = target[rows]
        if depth == 0 or len(rows) < 2 * least or np.ptp(y) == 0:
            return leaf(rows)
        best = (1e-12, None, None)
        whole = y.sum() ** 2 / len(rows)
        for f in pick():
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")):
                low = v <= cut
                n = int(low.sum())
                if least <= n <= len(rows) - least:
                    s = y[low].sum()
                    gain = s**2 / n + (y.sum() - s) ** 2 / (len(rows) - n) - whole
                    if gain > best[0]:
                        best = (gain, f, float(cut))
        if best[1] is None:
            return leaf(rows)
        low = x[rows, best[1]] <= best[2]
        return int(best[1]), best[2], grow(rows[low], depth - 1), grow(rows[~low], depth - 1)

    return grow(np.flatnonzero(weight > 0), depth)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, least: int = 4, seed: int = 7) -> list[Tree]:
    """A random forest for labels 0 and 1: bootstrap rows, a random subset of features in each node, leaf means."""
    rng, out, some = np.random.default_rng(seed), [], max(1, int(np.sqrt(x.shape[1])) + 1)
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        xs, ys = x[rows], y[rows].astype(float)
        out.append(grown(xs, ys, np.ones(len(ys)), depth, least, lambda: rng.permutation(x.shape[1])[:some], lambda r, ys=ys: round(float(ys[r].mean()), 5)))
    return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5) -> tuple[float, list[Tree]]:
    """Gradient-boosted trees for log-loss: the start and the trees, whose sum is the log-odds."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, out = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        rest, curve = y - p, p * (1 - p)
        tree = grown(x, rest, np.ones(len(y)), depth, least, lambda: range(x.shape[1]), lambda r, a=rest, b=curve: round(float(rate * a[r].sum() / (b[r].sum() + 1.0)), 5))
        margin = margin + applied(tree, x)
        out.append(tree)
    return start, out


def applied(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, applied(left, x), applied(right, x))


def expression(tree: Tree, feature) -> Column:
    """The tree over feature(k), the column of the k-th feature."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, left, right = tree
    return F.when(feature(f) <= F.lit(cut), expression(left, feature)).otherwise(expression(right, feature))


def total(trees: list[Tree], feature) -> Column:
    out = F.lit(0.0)
    for t in trees:
        out = out + expression(t, feature)
    return out
