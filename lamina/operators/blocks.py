"""Search of a query set over all vectors in blocks: a grid of shards and blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block: what one task holds.
SHARD_ROWS, BLOCK_ROWS = 8_192, 4_096
KEYS = ["dim", "shard", "block"]


def valid_vectors(df: DataFrame, vec_id: str, vector: str, nonzero: bool = False) -> DataFrame:
    """id, vector (doubles) and dim of the rows that take part: one for each id.

    Rows whose id is null, or whose vector is null, empty or holds a null or non-finite component, don't;
    nonzero: nor do zero vectors. Of rows that repeat an id the one with the least vector counts.
    """
    rows = df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    if nonzero:
        rows = rows.filter(F.exists("vector", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def matrix(table: pa.Table, column: str = "vector") -> np.ndarray:
    values = table.column(column).combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), -1) if len(table) else np.zeros((0, 0))


def search(
    rows: DataFrame,
    queries: DataFrame,
    kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    k: int,
    score: str,
    shard_rows: int | Column = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    *,
    read: Callable[[pa.Table, str], object] = matrix,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what the kernel finds for each query in each shard.

    Shards and blocks are dealt by a hash of the id, and meet in groups of one of each, so that a group
    has a bounded size and every query meets every shard once. Only vectors of equal width meet. The
    kernel gets ids and matrix of a shard, ids and matrix of a block, and returns query ids, ids and
    scores, at most k for each query; ties must go to the smaller id. read makes what the kernel gets of the vectors.
    shard_rows may depend on dim.
    """
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    asked = queries.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    grid = sizes.join(asked, "dim")  # one row a width

    def part(name: str, salt: int):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(name)).cast("int")

    def every(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    left = rows.join(F.broadcast(grid), "dim").withColumn("shard", part("shards", 1)).withColumn("block", every("blocks"))
    right = queries.join(F.broadcast(grid), "dim").withColumn("block", part("blocks", 2)).withColumn("shard", every("shards"))

    def cell(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not len(shard) or not len(block):
            found = (np.zeros(0, np.int64),) * 3
        else:
            found = kernel(shard.column("id").to_numpy(), read(shard, "vector"), block.column("q_id").to_numpy(), read(block, "q_vector"))
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], kind)})

    kind = {"bigint": pa.int64(), "double": pa.float64()}[score]
    columns = [*KEYS, "id", "vector"]
    right = right.select([F.col(c).alias(f"q_{c}") for c in columns])
    cells = left.select(columns).groupBy(KEYS).cogroup(right.groupBy([f"q_{c}" for c in KEYS]))
    found = cells.applyInArrow(cell, f"query_id bigint, vec_id bigint, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, best first, ties to the smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]
