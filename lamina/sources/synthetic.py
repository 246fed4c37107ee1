"""Seeded vectors with and without clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def sphere_clusters(centers: int, each: int, width: int, noise: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors around random unit centers, and the center of each."""
    rng = np.random.RandomState(seed)
    middle = unit(rng.normal(size=(centers, width)))
    truth = np.repeat(np.arange(centers), each)
    return unit(middle[truth] + rng.normal(scale=noise, size=(len(truth), width))), truth


def blobs(n: int, width: int, centers: int, seed: int, spread: float = 1.0, box: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian blobs around centers drawn from a box, each row over its norm."""
    rng = np.random.RandomState(seed)
    middle = rng.uniform(-box, box, size=(centers, width))
    truth = np.sort(np.arange(n) % centers)
    return unit(middle[truth] + rng.normal(scale=spread, size=(n, width))), truth


def random_units(n: int, width: int, seed: int) -> np.ndarray:
    return unit(np.random.RandomState(seed).normal(size=(n, width)))


#: Rows that a block of a generated table draws from one seed.
BLOCK = 4_096


def _generated(spark: SparkSession, n: int, seed: int, draw: Callable[[np.random.RandomState, np.ndarray], np.ndarray], centers: int) -> DataFrame:
    """id, vector, dim, truth: rows made by tasks, block by block, so that a block is the same wherever it is made."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["id"].tolist():
                ids = np.arange(block * BLOCK, min(n, (block + 1) * BLOCK))
                truth = ids * centers // n
                vectors = unit(draw(np.random.RandomState([seed, block % 2**32, 1]), truth))
                yield pd.DataFrame({"id": ids, "vector": list(vectors), "dim": np.int32(vectors.shape[1]), "truth": truth})

    return spark.range(-(-n // BLOCK)).mapInPandas(rows, "id bigint, vector array<double>, dim int, truth bigint")


def blob_table(spark: SparkSession, n: int, width: int, centers: int, seed: int, spread: float = 1.0, box: float = 10.0) -> DataFrame:
    """As blobs, of any number of rows, as a table: id, vector, dim, truth."""
    middle = np.random.RandomState(seed).uniform(-box, box, size=(centers, width))
    return _generated(spark, n, seed, lambda rng, truth: middle[truth] + rng.normal(scale=spread, size=(len(truth), width)), centers)


def sphere_table(spark: SparkSession, n: int, width: int, centers: int, noise: float, seed: int) -> DataFrame:
    """As sphere_clusters, of any number of rows, as a table: id, vector, dim, truth."""
    middle = unit(np.random.RandomState(seed).normal(size=(centers, width)))
    return _generated(spark, n, seed, lambda rng, truth: middle[truth] + rng.normal(scale=noise, size=(len(truth), width)), centers)


def to_table(spark: SparkSession, vectors: np.ndarray) -> DataFrame:
    """id, vector, dim."""
    rows = [(i, v.tolist(), len(v)) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, vector array<double>, dim int")
