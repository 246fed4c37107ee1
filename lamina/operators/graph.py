"""Weighted neighbour graphs as edge tables (i, j, w)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, TOLERANCE, FLOOR = 64, 1e-5, 1e-3


def bandwidths(distances: np.ndarray, k: float, overall_mean: float) -> tuple[np.ndarray, np.ndarray]:
    """sigma and rho of each row of neighbour distances (in order of rank).

    rho is the first positive distance. sigma makes the summed strengths of all but the first neighbour equal
    log2(k): found by bisection, doubling while there is no upper end, at most STEPS times; not less
    than FLOOR times the row's mean distance (the overall mean where rho is 0).
    """
    n, width = distances.shape
    positive = distances > 0
    rho = np.where(positive.any(axis=1), distances[np.arange(n), positive.argmax(axis=1)], 0.0)
    beyond = distances[:, 1:] - rho[:, None]
    low, high, middle = np.zeros(n), np.full(n, np.inf), np.ones(n)
    live, target = np.arange(n), np.log2(k)
    for _ in range(STEPS):
        if not len(live):
            break
        far = beyond[live]
        total = np.zeros(len(live))
        for c in range(width - 1):
            total += np.where(far[:, c] > 0, np.exp(-(far[:, c] / middle[live])), 1.0)
        open_ = np.abs(total - target) >= TOLERANCE
        live, above = live[open_], (total > target)[open_]
        down, up = live[above], live[~above]
        high[down] = middle[down]
        middle[down] = (low[down] + high[down]) / 2
        low[up] = middle[up]
        middle[up] = np.where(np.isinf(high[up]), middle[up] * 2, (low[up] + high[up]) / 2)
    least = FLOOR * np.where(rho > 0, distances.mean(axis=1), overall_mean)
    return np.maximum(middle, least), rho


def sigma_rho(knn: DataFrame, k: int) -> DataFrame:
    """i, sigma, rho of each row of a neighbour table; rows may have fewer than k neighbours."""
    mean = knn.agg(F.avg("dist")).first()[0] or 0.0
    rows = knn.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dist"))), lambda x: x["dist"]).alias("d"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            widths = batch["d"].map(len).to_numpy()
            sigma, rho = np.zeros(len(batch)), np.zeros(len(batch))
            for width in np.unique(widths):
                some = np.flatnonzero(widths == width)
                sigma[some], rho[some] = bandwidths(np.stack(batch["d"].iloc[some].to_numpy()), k, mean)
            yield pd.DataFrame({"i": batch["i"], "sigma": sigma, "rho": rho})

    return rows.mapInPandas(fit, "i bigint, sigma double, rho double")


def directed(knn: DataFrame, k: int) -> DataFrame:
    """Membership strengths: 1 up to rho, then falling with sigma; no edge to oneself, none of strength 0."""
    beyond = F.col("dist") - F.col("rho")
    strength = F.when((beyond <= 0) | (F.col("sigma") == 0), 1.0).otherwise(F.exp(-(beyond / F.col("sigma"))))
    edges = knn.filter("j >= 0 and i <> j").join(sigma_rho(knn, k), "i")
    return edges.select("i", "j", strength.alias("w")).filter("w <> 0")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")


def fuzzy_union(edges: DataFrame) -> DataFrame:
    """W + W' - W * W' (element by element) with zeros dropped. (i, j) must be unique in edges."""
    both = edges.unionByName(transpose(edges)).groupBy("i", "j")
    total = both.agg(F.sum("w").alias("s"), F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0).alias("p"))
    return total.select("i", "j", (F.col("s") - F.col("p")).alias("w")).filter("w <> 0")


def add(a: DataFrame, b: DataFrame, sign: float = 1.0) -> DataFrame:
    """a + sign * b with zeros dropped."""
    both = a.unionByName(b.select("i", "j", (F.col("w") * sign).alias("w")))
    return both.groupBy("i", "j").agg(F.sum("w").alias("w")).filter("w <> 0")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product element by element with zeros dropped."""
    return a.join(b.withColumnRenamed("w", "w2"), ["i", "j"]).select("i", "j", (F.col("w") * F.col("w2")).alias("w")).filter("w <> 0")


def hadamard(edges: DataFrame) -> DataFrame:
    """W * W' element by element."""
    return multiply(edges, transpose(edges))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product with zeros dropped."""
    right = b.select(F.col("i").alias("m"), F.col("j").alias("c"), F.col("w").alias("w2"))
    met = a.join(right, a["j"] == right["m"])
    return met.groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("w") * F.col("w2")).alias("w")).filter("w <> 0")


def matmul_dense(a: DataFrame, rows: DataFrame, vector: str = "x") -> DataFrame:
    """id, x: edges times a table (id, x array)."""
    right = rows.select(F.col("id").alias("j"), F.posexplode(vector).alias("pos", "value"))
    sums = a.join(right, "j").groupBy(F.col("i").alias("id"), "pos").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return as_vectors(sums)


def as_vectors(sums: DataFrame) -> DataFrame:
    """id, x from (id, pos, value)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return sums.groupBy("id").agg(F.transform(ordered, lambda s: s["value"]).alias("x"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.count("*").alias("degree"), F.sum("w").alias("weight"))


def l1_rows(edges: DataFrame) -> DataFrame:
    """Each row over the sum of its absolute weights (1e-12 at least)."""
    sums = edges.groupBy("i").agg(F.greatest(F.sum(F.abs("w")), F.lit(1e-12)).alias("s"))
    return edges.join(sums, "i").select("i", "j", (F.col("w") / F.col("s")).alias("w"))
