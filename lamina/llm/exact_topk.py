"""Exact top-k inner-product search by an impact-ordered, score-at-a-time index.

A shard's index holds, for each dimension, its vectors in LEVELS segments of descending value; a segment's
quantised impact on a query is the most that a member can get from it. For a query all segments are put in
descending order of impact and added to accumulators one after the other, whatever dimension they come
from. What a vector may still gain is at most its number of unseen dimensions times the impact of the next
segment. The best accumulators so far are scored exactly, which gives a score that k vectors reach; only
vectors whose bound is not below it can be members. Processing stops once these are few, and they are
all scored exactly: the bound is the proof that no other vector belongs to the result.

Numbers are 64-bit integers where no sum can leave them, which is known from the greatest components, and integers
of any size elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import blocks as vectors

K, SCALE, EVERY = 5, 256, 50
LEVELS = 24
#: Processing stops at so many possible members, as a share of the shard.
FEW = 1 / 2


class ImpactIndex:
    """Segments of each dimension, kept as the segment that every vector belongs to: what a batch of segments adds to the
    accumulators is looked up for all vectors of a dimension at once."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, levels: int = LEVELS):
        self.ids, self.rows = ids, rows
        self.least = -(1 << 62) if rows.dtype == np.int64 else -(1 << 5_000)  # below any bound
        n, self.width = rows.shape
        order = np.argsort(rows, axis=0, kind="stable")
        edges = np.unique(np.linspace(0, n, min(levels, n) + 1).astype(int))
        #: of each dimension: the least and greatest value of each segment, and the segment of each vector
        self.low, self.high = rows[order[edges[:-1]], np.arange(self.width)].T, rows[order[edges[1:] - 1], np.arange(self.width)].T
        self.segment = np.empty((self.width, n), np.int16)
        np.put_along_axis(self.segment, order.T, np.repeat(np.arange(len(edges) - 1, dtype=np.int16), np.diff(edges))[None, :], axis=1)
        self.shift = self.width.bit_length()

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best, without the vector whose id is own."""
        impact = np.maximum(query[:, None] * self.low, query[:, None] * self.high)
        order = np.argsort(-impact, axis=None, kind="stable")
        steps = (impact.ravel() << self.shift) + 1  # a sum and the number of dimensions seen in one number
        held = np.zeros(len(self.ids), self.rows.dtype)
        is_own = np.flatnonzero(self.ids == own)
        total, few = len(order), max(8 * k, int(len(self.ids) * FEW))
        at, check = 0, total * 2 // 3
        while True:
            batch = np.zeros(total, self.rows.dtype)
            batch[order[at:check]] = steps[order[at:check]]
            batch = batch.reshape(impact.shape)
            for d in np.flatnonzero((batch != 0).any(axis=1)).tolist():
                held += batch[d].take(self.segment[d])
            at = check
            bound = held >> self.shift
            if at < total:
                bound = bound + (self.width - (held & ((1 << self.shift) - 1))) * impact.flat[order[at]]
            bound[is_own] = self.least
            some = _greatest(bound, 4 * k)
            some = some[self.ids[some] != own]
            sure = self.rows[some] @ query
            reached = sure[_greatest(sure, k)].min() if len(sure) >= k else self.least + 1
            possible = np.flatnonzero(bound >= reached)
            if at == total or len(possible) <= few:
                scores = self.rows[possible] @ query
                if scores.dtype != np.int64 and len(scores) and max(scores.max(), -scores.min()) >= 1 << 63:
                    raise OverflowError("a score is beyond 64 bits")
                scores = scores.astype(np.int64)
                best = vectors.best_of(scores, self.ids[possible], k)
                return self.ids[possible][best], scores[best]
            check = min(total, at + max(1, total // 6))


def _greatest(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest (or all) values."""
    if len(values) <= k:
        return np.arange(len(values))
    order = np.argpartition(values, len(values) - k) if values.dtype == np.int64 else np.argsort(values, kind="stable")
    return order[len(values) - k :]


def _scaled(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as integers of any size."""
    made = np.empty(rows.shape, object)
    # from 2^53 on a double is an integer, and the product is made of integers
    made.flat = [scale * int(x) if abs(x) >= 2**53 else math.floor(scale * x) for x in rows.ravel().tolist()]
    return made


def _narrow(rows: np.ndarray, queries: np.ndarray, scale: int) -> bool:
    """Whether all sums, with the count of dimensions beside them, stay within 64 bits."""
    width = rows.shape[1]
    greatest = [float(np.abs(x).max(initial=0)) * scale + 1 for x in (rows, queries)]
    return greatest[0] * greatest[1] * width < 2.0 ** (61 - width.bit_length())


def exact_topk(
    df: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding", levels: int = LEVELS
) -> DataFrame:
    """Return query_id, rank, vec_id, score: the k rows of greatest inner product for each query.

    Components x count as floor(scale * x). Queries are the rows whose id is divisible by every; all rows but
    a query's own are candidates; ties go to the smaller id. See blocks.valid_vectors for the rows that take no part
    and for repeated ids; only vectors of a query's width are its candidates. Fewer than k candidates
    are all returned; without any a query has no rows; so has an empty table. Other columns are not read, whatever their
    names. Components may have any finite size; where a possible member's score is beyond 64 bits, which the result can't
    hold, the query fails with an OverflowError.
    """
    rows = vectors.valid_vectors(df, vec_id, vector)

    def kernel(ids, matrix, query_ids, queries):
        if _narrow(matrix, queries, scale):
            matrix, queries = (np.floor(x * scale).astype(np.int64) for x in (matrix, queries))
        else:
            matrix, queries = _scaled(matrix, scale), _scaled(queries, scale)
        index = ImpactIndex(ids, matrix, levels)
        found = [index.top(i, q, k) for i, q in zip(query_ids.tolist(), queries)]
        return np.repeat(query_ids, [len(f) for f, _ in found]), np.concatenate([f for f, _ in found]), np.concatenate([s for _, s in found])

    return vectors.search(rows, rows.filter(F.col("id") % every == 0), kernel, k, "bigint")


def oracle_sql(k: int = K, every: int = EVERY, scale: int = SCALE) -> str:
    """The production query as one SQL statement over embeddings (every query against every row)."""
    return f"""
with e as (
  select vec_id, [floor({scale} * x::double) for x in embedding] as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v, c.v)::bigint as score
  from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % {every} = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= {k}
"""
