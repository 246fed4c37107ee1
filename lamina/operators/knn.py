"""Exact k-nearest-neighbour tables.

A table has a row for each neighbour: i, rank, j, raw, dist. With cosine and bit-Jaccard distance a row is
its own neighbour of rank 0 and counts among the k; with integer inner products it is left out. Ties go
to the smaller id. Work is blocked: see blocks.search.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import vectors as V

from . import blocks


def vector_table(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector, dim of the rows that hold a finite vector."""
    return blocks.valid_vectors(df, vec_id, vector)


def all_unit(rows: DataFrame) -> DataFrame:
    """One row, all_unit: whether every vector has norm 1 within the tolerance (true of none)."""
    return rows.agg(F.coalesce(F.bool_and(F.abs(V.norm(F.col("vector")) - 1) <= V.UNIT_TOLERANCE), F.lit(True)).alias("all_unit"))


def normalized(rows: DataFrame) -> DataFrame:
    """rows as they are if all are unit vectors; else every one over its norm."""
    if all_unit(rows).first()[0]:
        return rows
    return rows.withColumn("vector", V.l2_normalize(F.col("vector")))


def _in_order(rows: np.ndarray, query: np.ndarray, term) -> np.ndarray:
    """Sum of term over components, from the first to the last."""
    total = np.zeros(len(rows))
    for d in range(len(query)):
        total += term(rows[:, d], query[d])
    return total


def _top(rough: np.ndarray, slack: float, exact, ids: np.ndarray, own: int, k: int):
    """The k best of a shard: whatever the rough scores can't rule out is scored exactly."""
    rough = np.where(ids == own, -np.inf, rough)
    some = np.flatnonzero(np.isfinite(rough))
    if len(some) > k:
        some = np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack)
    scores = exact(some)
    best = blocks.best_of(scores, ids[some], k)
    return ids[some][best], scores[best]


def _gather(query_ids: np.ndarray, found: list):
    return np.repeat(query_ids, [len(f) for f, _ in found]), np.concatenate([f for f, _ in found]), np.concatenate([s for _, s in found])


def inner_product_kernel(k: int):
    def kernel(ids, rows, query_ids, queries):
        rough = queries @ rows.T
        slack = 1e-9 * max(1.0, float(np.abs(rough).max(initial=0)))
        found = [
            _top(rough[n], slack, lambda some, q=q: _in_order(rows[some], q, np.multiply), ids, own, k)
            for n, (own, q) in enumerate(zip(query_ids.tolist(), queries))
        ]
        return _gather(query_ids, found)

    return kernel


#: Queries that are compared with a shard at once, rows of it whose best stands for all, and pairs that are scored at once.
ASKED, TOGETHER, PAIRS = 128, 64, 1 << 20
#: Rows of a shard for Euclidean distances, in vectors of up to 64 components; SHARD_ROWS at least in wider ones.
LARGE_SHARD, LARGE_BLOCK = 65_536, 8_192


def euclidean_kernel(k: int):
    """Products in single precision, with the bound of their rounding errors, rule rows out; the rest is scored exactly.

    The k-th best of the groups' best rows is no better than the k-th best row, so nothing worse by twice the bound counts.
    """

    def kernel(ids, rows, query_ids, queries):
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        n, width = rows.shape
        middle = rows.mean(axis=0)
        near = rows - middle
        scale = float(np.abs(near).max()) * width**0.5 or 1.0  # all norms are below
        near /= scale
        held = np.zeros((-(-n // TOGETHER) * TOGETHER, width + 1), np.float32)
        held[:n, :width], held[:n, width], held[n:, width] = near, -0.5 * (near * near).sum(axis=1), -np.inf
        offset = max(float(np.abs(rows).max()), float(np.abs(middle).max())) * width**0.5 / scale
        del near
        held, columns = np.ascontiguousarray(held.T), np.ascontiguousarray(rows.T)
        groups = held.shape[1] // TOGETHER
        found = []
        for start in range(0, len(queries), ASKED):
            own, some = query_ids[start : start + ASKED], queries[start : start + ASKED]
            asked = np.ones((len(some), width + 1), np.float32)
            far = (some - middle) / scale
            asked[:, :width] = far
            norm = np.sqrt((far * far).sum(axis=1))
            slack = (width + 8) * (2.0**-22 * (norm + 0.5) + 2.0**-50 * (norm * norm + (offset + norm) * (norm + 1)))
            rough = asked @ held
            at = np.minimum(np.searchsorted(ids, own), n - 1)
            hit = np.flatnonzero(ids[at] == own)
            rough[hit, at[hit]] = -np.inf
            if groups > k and 1e-140 < scale < 1e140:  # else squares overflow or vanish
                best = np.partition(rough.reshape(len(some), groups, TOGETHER).max(axis=2), groups - k, axis=1)[:, groups - k]
                least = np.nextafter((best - 2 * slack).astype(np.float32), np.float32(-np.inf))
                places = np.flatnonzero(~(rough < least[:, None]))
            else:
                places = np.arange(rough.size)
            q, r = np.divmod(places, rough.shape[1])
            able = r < n
            able[able] = ids[r[able]] != own[q[able]]
            q, r = q[able], r[able]
            ends = np.searchsorted(q, np.arange(len(some) + 1))
            first = 0
            while first < len(some):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + PAIRS, side="right")) - 1)
                found.append(_scored(columns, some.T, r[ends[first] : ends[last]], q[ends[first] : ends[last]], k, ids, own))
                first = last
        return tuple(np.concatenate(x) for x in zip(*found))

    return kernel


def _scored(columns: np.ndarray, asked: np.ndarray, r: np.ndarray, q: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray):
    """The k nearest of the pairs of each query: squares are added from the first component to the last."""
    total = np.zeros(len(r))
    for row, query in zip(columns, asked):
        gap = query[q] - row[r]
        total += gap * gap
    order = np.lexsort((r, total, q))  # rows are in order of ids
    q = q[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return own[q[best]], ids[r[order[best]]], -total[order[best]]


def euclidean_search(rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score (the negative square) of the k nearest of all rows, without the row itself."""
    shard = F.least(F.lit(LARGE_SHARD), F.greatest(F.lit(blocks.SHARD_ROWS), F.floor(F.lit(64 * LARGE_SHARD) / F.col("dim"))))
    return blocks.search(rows, rows, euclidean_kernel(k), k, "double", shard_rows=shard, block_rows=LARGE_BLOCK)


def jaccard_kernel(k: int):
    def kernel(ids, rows, query_ids, queries):
        bits = rows.astype(np.int64)
        found = []
        for own, q in zip(query_ids.tolist(), queries.astype(np.int64)):
            both = np.bitwise_count(bits & q).sum(axis=1)
            either = np.bitwise_count(bits | q).sum(axis=1)
            score = np.where(either == 0, 0.0, both / np.maximum(either, 1))
            found.append(_top(score, 0.0, lambda some: score[some], ids, own, k))
        return _gather(query_ids, found)

    return kernel


def _with_self(rows: DataFrame, others: DataFrame, own: Column) -> DataFrame:
    first = rows.select(F.col("id").alias("i"), F.lit(0).alias("rank"), F.col("id").alias("j"), own.alias("score"))
    return first.unionByName(others.select(F.col("query_id").alias("i"), "rank", F.col("vec_id").alias("j"), "score"))


def knn_cosine(rows: DataFrame, k: int = 15, found: DataFrame | None = None) -> DataFrame:
    """k nearest by cosine, with the row itself first; dist is 0 also where similarity is not positive.

    found: the neighbours (query_id, rank, vec_id, score) of normalized rows, where another search gives them.
    """
    rows = normalized(rows)
    found = blocks.search(rows, rows, inner_product_kernel(k - 1), k - 1, "double") if found is None else found
    table = _with_self(rows, found, V.dot(F.col("vector"), F.col("vector")))
    raw = F.when(F.col("score") > 0, -F.col("score")).otherwise(F.lit(V.NO_SIMILARITY))
    return table.select("i", "rank", "j", F.col("score").alias("sim"), raw.alias("raw"), V.cosine_distance(raw).alias("dist"))


def knn_int8(rows: DataFrame, k: int = 15, found: DataFrame | None = None) -> DataFrame:
    """k rows of greatest integer inner product, without the row itself; rank from 0."""
    found = blocks.search(rows, rows, inner_product_kernel(k), k, "double") if found is None else found
    raw = -F.col("score").cast("bigint")
    return found.select(F.col("query_id").alias("i"), (F.col("rank") - 1).alias("rank"), F.col("vec_id").alias("j"), raw.alias("raw"), V.int8_distance(raw.cast("double")).alias("dist"))


def knn_bits(rows: DataFrame, k: int = 15, found: DataFrame | None = None) -> DataFrame:
    """k nearest by bit-Jaccard over packed words, with the row itself first."""
    found = blocks.search(rows, rows, jaccard_kernel(k - 1), k - 1, "double") if found is None else found
    words = F.transform("vector", lambda x: x.cast("bigint"))
    table = _with_self(rows, found, -V.jaccard_raw(words, words))
    raw = -F.col("score")
    return table.select("i", "rank", "j", raw.alias("raw"), (V.jaccard_distance(raw) + F.lit(0.0)).alias("dist"))


#: Neighbour table of a metric, and how many neighbours it has besides the row itself.
TABLES = {"cosine": (knn_cosine, -1), "int8": (knn_int8, 0), "bits": (knn_bits, -1)}


def knn_approximate(rows: DataFrame, k: int = 15, metric: str = "cosine", **options) -> DataFrame:
    """The metric's neighbour table from forests and neighbour descent instead of all pairs; options are those of
    descent.neighbor_descent."""
    from .descent import neighbor_descent

    table, more = TABLES[metric]
    rows = normalized(rows) if metric == "cosine" else rows
    found = neighbor_descent(rows, k + more, metric=metric, **options)
    return table(rows, k, found.select(F.col("i").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("j").alias("vec_id"), F.col("sim").alias("score")))


def knn_euclidean(rows: DataFrame, k: int, squared: bool = False) -> DataFrame:
    """k nearest by Euclidean distance, with the row itself first."""
    found = euclidean_search(rows, k - 1) if k > 1 else None
    own = rows.select(F.col("id").alias("i"), F.lit(0).alias("rank"), F.col("id").alias("j"), F.lit(0.0).alias("dist"))
    if found is None:
        return own
    far = -F.col("score") if squared else F.sqrt(-F.col("score"))
    return own.unionByName(found.select(F.col("query_id").alias("i"), "rank", F.col("vec_id").alias("j"), far.alias("dist")))


def core_distances(rows: DataFrame, min_samples: int) -> DataFrame:
    """id, core: distance to neighbour number min_samples, the row itself being number 0; 0 for one or less."""
    if min_samples <= 1:
        return rows.select("id", F.lit(0.0).alias("core"))
    table = knn_euclidean(rows, min_samples + 1)
    return table.groupBy(F.col("i").alias("id")).agg(F.max("dist").alias("core"))


def reverse_neighbors(knn: DataFrame) -> DataFrame:
    """Every (i, j) also offered to j."""
    pairs = knn.select("i", "j").filter("i <> j")
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def mutual(knn: DataFrame) -> DataFrame:
    """Pairs i < j that are neighbours of each other."""
    pairs = knn.select("i", "j").filter("i <> j")
    return pairs.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).count().filter("count > 1").select("i", "j")


def duplicates(knn: DataFrame) -> DataFrame:
    """Pairs i < j of the table whose distance is not above the greatest that any row has at rank 0."""
    limit = knn.filter("rank = 0").agg(F.max("dist").alias("limit"))
    near = knn.join(F.broadcast(limit)).filter((F.col("dist") <= F.col("limit")) & (F.col("i") != F.col("j")))
    return near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
