"""Approximate nearest neighbours by multiprobe p-stable hashing.

A hash is floor((a . x + b) / width) with a from a normal (2-stable) distribution; a table's bucket is HASHES
of them together. A query looks into its own bucket and into up to PROBES perturbed ones of each of TABLES
tables: a hash is moved by one towards its nearer boundaries first. Sets of moves are visited in the order
of their estimated success, the expected sum of squared distances to the boundaries crossed. What the
tables give is merged, and every candidate's inner product is computed exactly.

Inner products become distances by one more component that brings all vectors to the same norm.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import blocks as vectors

K, EVERY, SEED = 20, 20, 7
#: Chosen for vectors without any structure, the hardest case: see the README for recall and rows visited.
TABLES, HASHES, PROBES, WIDTH = 4, 4, 80, 1.3


@lru_cache(maxsize=4)
def probe_sets(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of moves by rank of their boundary distance, likeliest first; the empty set is not among them.

    Ranks j and 2 * hashes - 1 - j are the two moves of one hash, and never both in a set.
    """
    m = hashes
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    heap, out = [(expected[0], (0,))], []
    while heap and len(out) < probes:
        cost, moves = heapq.heappop(heap)
        if all(2 * m - 1 - j not in moves for j in moves):
            out.append(moves)
        last = moves[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost + expected[last + 1], (*moves, last + 1)))
            heapq.heappush(heap, (cost + expected[last + 1] - expected[last], (*moves[:-1], last + 1)))
    return out


class MultiprobeIndex:
    def __init__(self, ids, rows, norm, tables=TABLES, hashes=HASHES, probes=PROBES, width=WIDTH, seed=SEED):
        self.ids, self.rows, self.norm = ids, rows, norm
        self.near = rows.astype(np.float32)
        self.tables, self.hashes, self.width = tables, hashes, width * norm
        rng = np.random.default_rng(seed)
        self.lines = rng.standard_normal((rows.shape[1] + 1, tables * hashes))
        self.shift = rng.random(tables * hashes) * self.width
        self.mix = rng.integers(0, 2**63, hashes, np.int64) | 1
        self.moves = np.zeros((probes + 1, 2 * hashes), np.int64)
        for i, chosen in enumerate(probe_sets(hashes, probes), start=1):
            self.moves[i, list(chosen)] = 1
        spare = np.sqrt(np.maximum(norm * norm - (rows * rows).sum(axis=1), 0))
        keys = self._key(np.floor(self._project(np.column_stack((rows, spare)))).astype(np.int64))
        self.order = [np.argsort(keys[:, t], kind="stable") for t in range(tables)]
        self.sorted = [keys[o, t] for t, o in enumerate(self.order)]

    def _project(self, points):
        return ((points @ self.lines + self.shift) / self.width).reshape(len(points), self.tables, self.hashes)

    def _key(self, cells):
        return (cells * self.mix).sum(axis=2)

    def probes(self, queries: np.ndarray) -> np.ndarray:
        """Keys of the buckets to visit: query, table, probe in order."""
        at = self._project(np.column_stack((queries, np.zeros(len(queries)))))
        cells = np.floor(at).astype(np.int64)
        below = at - cells
        order = np.argsort(np.concatenate((below, 1 - below), axis=2), axis=2)
        step = np.concatenate((-self.mix, self.mix))[order]
        with np.errstate(over="ignore"):
            return self._key(cells)[:, :, None] + step @ self.moves.T

    def candidates(self, keys: np.ndarray) -> np.ndarray:
        """Places of the vectors in all of one query's buckets, however many they hold."""
        first, last = (np.stack([np.searchsorted(self.sorted[t], keys[t], side=s) for t in range(self.tables)]) for s in ("left", "right"))
        hit = np.zeros(len(self.ids), bool)
        for t in range(self.tables):
            for a, b in zip(first[t].tolist(), last[t].tolist()):
                if a < b:
                    hit[self.order[t][a:b]] = True
        return np.flatnonzero(hit)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        found = []
        for own, query, keys in zip(query_ids.tolist(), queries, self.probes(queries)):
            some = self.candidates(keys)
            some = some[self.ids[some] != own]
            if len(some) < k:
                some = np.flatnonzero(self.ids != own)
            if len(some) > k:  # what single precision can't rule out is added up in double, in one order for all
                rough = self.near[some] @ query.astype(np.float32)
                some = some[rough >= np.partition(rough, len(some) - k)[len(some) - k] - 1e-4 * self.norm * self.norm]
            scores = np.zeros(len(some))
            for d in range(len(query)):
                scores += self.rows[some, d] * query[d]
            best = vectors.best_of(scores, self.ids[some], k)
            found.append((self.ids[some][best], scores[best]))
        return np.repeat(query_ids, [len(f) for f, _ in found]), np.concatenate([f for f, _ in found]), np.concatenate([s for _, s in found])


def nearest(
    df: DataFrame,
    k: int = K,
    every: int = EVERY,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    width: float = WIDTH,
    seed: int = SEED,
) -> DataFrame:
    """Return query_id, rank, vec_id, score: the k nearest rows found for each query.

    Nearness is the inner product in double precision. Queries are the rows whose id is divisible by
    every; all rows but a query's own may be found; ties go to the smaller id. See blocks.valid_vectors for the rows that take
    no part (zero vectors don't) and for repeated ids. Where the buckets visited hold fewer than k rows
    of a shard, all its rows are scored, so fewer than k come back only if there are no more. An empty
    table gives no rows. Every row is indexed. width is in units of the greatest norm.
    """
    rows = vectors.valid_vectors(df, vec_id, vector, nonzero=True)
    norm = rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 1.0

    def kernel(ids, matrix, query_ids, queries):
        return MultiprobeIndex(ids, matrix, norm, tables, hashes, probes, width, seed).search(query_ids, queries, k)

    return vectors.search(rows, rows.filter(F.col("id") % every == 0), kernel, k, "double")
