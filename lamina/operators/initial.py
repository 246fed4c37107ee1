"""First layout of a graph by label propagation: partition, lay out the reduced graph, expand.

The partition's graph is laid out the same way until fewer than BASE vertices are left, which are placed by
principal components of their mean vectors (or at random where there are no vectors).
Two forms take the same steps: tables for graphs of any size, arrays for those that fit one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lamina.session import materialize

from . import embed, propagate

BASE = 64


def principal(vectors: np.ndarray, width: int) -> np.ndarray:
    """Leading principal components, signs by the greatest entry of each axis, moved and scaled to about -1..1."""
    centred = vectors - vectors.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    sign = np.where(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)] >= 0, 1.0, -1.0)
    out = np.zeros((len(vectors), width))
    k = min(width, len(s))
    out[:, :k] = (u * sign * s)[:, :k]
    return _spread(out)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x - x.mean()
    half = (x.max() - x.min()) / 2
    return x / half if half > 0 else x


def random_unit(n: int, width: int, seed: int) -> np.ndarray:
    x = np.random.RandomState(seed).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scaled_distances(vectors: np.ndarray, width: int) -> np.ndarray:
    """Classical multidimensional scaling of Euclidean distances."""
    d2 = ((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2)
    centre = np.eye(len(vectors)) - 1 / len(vectors)
    values, axes = np.linalg.eigh(-centre @ d2 @ centre / 2)
    order = np.argsort(-values)[:width]
    out = np.zeros((len(vectors), width))
    out[:, : len(order)] = axes[:, order] * np.sqrt(np.maximum(values[order], 0))
    return _spread(out)


def spectral(vectors: np.ndarray, width: int) -> np.ndarray:
    """Eigenvectors after the first of the normalised Laplacian of a Gaussian kernel of median width."""
    d2 = ((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2)
    median = np.median(d2[~np.eye(len(d2), dtype=bool)]) if len(d2) > 1 else 1.0
    kernel = np.exp(-d2 / (2 * median if median > 0 else 1.0))
    np.fill_diagonal(kernel, 0)
    root = 1 / np.sqrt(np.maximum(kernel.sum(axis=1), 1e-12))
    _, axes = np.linalg.eigh(np.eye(len(kernel)) - root[:, None] * kernel * root[None, :])
    out = np.zeros((len(vectors), width))
    some = axes[:, 1 : width + 1]
    out[:, : some.shape[1]] = some
    return _spread(out)


def base_layout(vectors: np.ndarray | None, n: int, width: int, seed: int, how: str = "pca") -> np.ndarray:
    if how == "random" or vectors is None:
        return random_unit(n, width, seed)
    return {"pca": principal, "mds": scaled_distances, "spectral": spectral}[how](vectors, width)


# Arrays -------------------------------------------------------------------------------------------------------


def _best(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each distinct group the place of the entry that is last by keys."""
    order = np.lexsort((*keys[::-1], group))
    last = np.append(group[order][1:] != group[order][:-1], True) if len(group) else np.zeros(0, bool)
    return order[last]


def vote_arrays(i, j, w, label):
    """As propagate.vote."""
    some = (label[i] < 0) & (label[j] >= 0)
    if not some.any():
        return label
    span = int(label.max()) + 1
    key, at = np.unique(i[some] * span + label[j[some]], return_inverse=True)
    votes = np.round(np.bincount(at, w[some]), 9)
    key, votes = key[votes >= 1.0], votes[votes >= 1.0]
    won = _best(key // span, votes, key % span)
    out = label.copy()
    out[key[won] // span] = key[won] % span
    return out


def adopt_arrays(i, j, w, label, seed, rounds=64):
    """As propagate.adopt."""
    label = label.copy()
    for _ in range(rounds):
        some = np.flatnonzero((label[i] < 0) & (label[j] >= 0))
        if not len(some):
            break
        won = some[_best(i[some], w[some], -j[some])]
        label[i[won]] = label[j[won]]
    rest = np.flatnonzero(label < 0)
    label[rest] = (embed.mix64(seed, rest) % np.uint64(max(int(label.max(initial=0)), 0) + 1)).astype(np.int64)
    return label


def partition_arrays(i, j, w, n, parts, rounds, seed):
    """As propagate.partition."""
    label = np.full(n, -1, np.int64)
    seeds = np.argsort(embed.mix64(seed, np.arange(n)), kind="stable")[:parts]
    label[seeds] = np.arange(len(seeds))
    for _ in range(rounds):
        label = vote_arrays(i, j, w, label)
    return np.unique(adopt_arrays(i, j, w, label, seed), return_inverse=True)[1]


def reduce_arrays(i, j, w, part, parts):
    sizes = np.bincount(part, minlength=parts)
    key, at = np.unique(part[i] * parts + part[j], return_inverse=True)
    p = key // parts
    return p, key % parts, np.clip(np.bincount(at, w) / np.sqrt(sizes[p]), 0.0, 1.0)


def expand_arrays(i, j, w, part, layout):
    """As propagate.expand."""
    n = len(part)
    sizes = np.bincount(part)
    back, forth = j * n + i, i * n + j
    order = np.argsort(forth, kind="stable")
    found = np.minimum(np.searchsorted(forth[order], back), len(forth) - 1)
    mutual = forth[order][found] == back
    both = np.where(mutual, w * w[order][found], 0.0) / np.sqrt(sizes[part[j]])
    total = np.bincount(i, both, minlength=n)
    near = np.stack([np.bincount(i, both * layout[part[j], c], minlength=n) for c in range(layout.shape[1])], axis=1)
    return 0.5 * (layout[part] + near / np.maximum(total, 1e-12)[:, None])


def initial_arrays(i, j, w, vectors, n, width, parts, rounds=20, epochs=50, scaling=0.5, noise=0.5, seed=42, how="pca"):
    """Places of n vertices; i, j are their numbers."""
    if n < BASE or not len(i):
        return base_layout(vectors, n, width, seed, how)
    part = partition_arrays(i, j, w, n, max(1, parts), rounds, seed)
    count = int(part.max()) + 1
    if count >= n:
        return base_layout(vectors, n, width, seed, how)
    a, b, v = reduce_arrays(i, j, w, part, count)
    sizes = np.bincount(part)
    means = None
    if vectors is not None:
        means = np.zeros((count, vectors.shape[1]))
        np.add.at(means, part, vectors)
        means /= sizes[:, None]
    below = initial_arrays(a, b, v, means, count, width, parts // 4, rounds, min(epochs, 255), scaling, noise, seed + 1, how)
    eps = epochs / np.maximum(epochs * v / v.max(), 1.0) if len(v) and v.max() > 0 else np.full(len(v), float(epochs))
    below = embed.layout_arrays(a, b, eps, below, epochs, 0.001 * epochs, noise, seed)
    out = expand_arrays(i, j, w, part, below)
    return scaling * (out - out.mean(axis=0))


# Tables -------------------------------------------------------------------------------------------------------


def initial_layout(
    edges: DataFrame, rows: DataFrame, width: int, parts: int, rounds: int = 20, epochs: int = 50, scaling: float = 0.5, noise: float = 0.5, seed: int = 42, how: str = "pca"
) -> DataFrame:
    """id, x for the vertices in rows (id, vector)."""
    n = rows.count()
    spark = rows.sparkSession
    if n < BASE:  # so few reach the driver
        held = rows.orderBy("id").collect()
        placed = base_layout(np.array([r["vector"] for r in held]), n, width, seed, how) if n else np.zeros((0, width))
        return spark.createDataFrame([(r["id"], x.tolist()) for r, x in zip(held, placed)], "id bigint, x array<double>")
    part = materialize(propagate.partition(edges, rows, max(1, parts), rounds, seed), "parts")
    below = materialize(propagate.reduce_graph(edges, part), "reduced")
    means = materialize(propagate.part_means(rows, part).withColumnRenamed("x", "vector"), "means")
    if means.count() >= n:
        return embed.random_layout(rows, width, seed)
    first = initial_layout(below, means, width, parts // 4, rounds, min(epochs, 255), scaling, noise, seed + 1, how)
    placed = materialize(embed.node_layout(below, first, epochs, 0.001 * epochs, noise, seed), "placed")
    return propagate.centred(propagate.expand(edges, part, placed), scaling)
