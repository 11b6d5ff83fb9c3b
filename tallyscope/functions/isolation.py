"""A small vectorised isolation forest for short series (Liu, Ting and Zhou, 2008).

All trees grow together, level by level, as arrays of shape (trees, nodes) in heap order: those of
one forest, or the forests of many series of equal length, one after the other. ``feature`` is -1
at a leaf. The caller decides how rows reach a task.
"""

from __future__ import annotations

import numpy as np

TREES = 50
SUBSAMPLE = 256
EULER = 0.5772156649015329


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    general = 2.0 * (np.log(big - 1.0) + EULER) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, general))


def grow(points: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Grow the forest; each tree sees at most ``SUBSAMPLE`` points, drawn without replacement."""
    return grow_many(points[None], seed)


def grow_many(points: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Forests of series of equal length, of shape (series, points, features).

    The draws depend on the seed and the length only, so each forest is the one that its series
    grows alone.
    """
    rng = np.random.default_rng(seed)
    series, n, width = points.shape
    size = min(SUBSAMPLE, n)
    rows = np.argsort(rng.random((TREES, n)), axis=1)[:, :size]
    sample = points[:, rows].reshape(-1, size, width)
    trees = len(sample)
    depth = int(np.ceil(np.log2(max(size, 2))))
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((trees, nodes), -1, dtype=np.int8)
    threshold = np.zeros((trees, nodes))
    count = np.zeros((trees, nodes))
    node = np.zeros((trees, size), dtype=np.int64)
    tree = np.broadcast_to(np.arange(trees)[:, None], (trees, size))
    alive = np.ones((trees, size), dtype=bool)
    count[:, 0] = size

    def draw(many: int) -> np.ndarray:
        return np.tile(rng.random((TREES, many)), (series, 1))

    for level in range(depth):
        first, many = 2**level - 1, 2**level
        at = tree[alive] * many + node[alive] - first
        low = np.full((width, trees * many), np.inf)
        high = np.full((width, trees * many), -np.inf)
        for f in range(width):
            values = sample[:, :, f][alive]
            np.minimum.at(low[f], at, values)
            np.maximum.at(high[f], at, values)
        low, high = (np.moveaxis(b.reshape(width, trees, many), 0, 2) for b in (low, high))
        varies = high > low
        options = varies.sum(axis=2)
        pick = np.floor(draw(many) * options).astype(int)
        chosen = np.argmax(np.cumsum(varies, axis=2) > pick[:, :, None], axis=2)
        lo = np.take_along_axis(low, chosen[:, :, None], axis=2)[:, :, 0]
        hi = np.take_along_axis(high, chosen[:, :, None], axis=2)[:, :, 0]
        split = options > 0
        cutoff = np.where(split, lo, 0.0)
        # an empty node's bounds are infinite and not used
        cutoff += draw(many) * np.subtract(hi, lo, out=np.zeros_like(hi), where=split)
        feature[:, first:first + many] = np.where(split, chosen, -1)
        threshold[:, first:first + many] = cutoff
        alive &= feature[tree, node] >= 0
        used = np.maximum(feature[tree, node], 0).astype(int)
        value = np.take_along_axis(sample, used[:, :, None], axis=2)[:, :, 0]
        child = 2 * node + 1 + (value > threshold[tree, node])
        node = np.where(alive, child, node)
        moved = tree[alive] * nodes + node[alive]
        count += np.bincount(moved, minlength=trees * nodes).reshape(trees, nodes)
    return {"feature": feature, "threshold": threshold, "count": count,
            "size": np.array([size]), "depth": np.array([depth])}


def score(
    forest: dict[str, np.ndarray], points: np.ndarray, series: np.ndarray | None = None
) -> np.ndarray:
    """Anomaly score per point in [-1, 0]; lower is more anomalous.

    ``series`` tells whose forest judges each point, when the forests of several were grown.
    """
    m = len(points)
    tree = np.arange(TREES)[None, :]
    if series is not None:
        tree = series[:, None] * TREES + tree
    node = np.zeros((m, TREES), dtype=np.int64)
    steps = np.zeros((m, TREES))
    row = np.arange(m)[:, None]
    for _ in range(int(forest["depth"][0])):
        used = forest["feature"][tree, node]
        inner = used >= 0
        right = points[row, np.maximum(used, 0)] > forest["threshold"][tree, node]
        node = np.where(inner, 2 * node + 1 + right, node)
        steps += inner
    length = (steps + _average_path(forest["count"][tree, node])).mean(axis=1)
    usual = float(_average_path(forest["size"])[0])
    return -np.power(2.0, -length / usual)
