"""Array files as tables: npy matrices, npz graphs and IDX images, and an npy writer.

Readers go through Spark's binaryFile source, so any store that Spark reads will do. Rows of a file are made in one
task; many files are read in parallel.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

IMAGES, LABELS = 2051, 2049
PIECE = 10_000


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _pieces(n: int) -> Iterator[slice]:
    for start in range(0, n, PIECE):
        yield slice(start, min(start + PIECE, n))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, id (row number in the file), vector. A one-dimensional array has vectors of one component."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                matrix = matrix.reshape(len(matrix), -1).astype(np.float64)
                for piece in _pieces(len(matrix)):
                    ids = np.arange(piece.start, piece.stop)
                    yield pd.DataFrame({"path": name, "id": ids, "vector": list(matrix[piece])})

    return _files(spark, path).mapInPandas(rows, "path string, id bigint, vector array<double>")


def graph_edges(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """i, j, w of an npz file with a graph in coordinate form (rows, cols, data) or compressed rows (indptr, indices,
    data); None if it is neither."""
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as held:
            data = held["data"].astype(np.float64)
            if "rows" in held:
                i, j = held["rows"], held["cols"]
            elif "row" in held:
                i, j = held["row"], held["col"]
            else:
                j = held["indices"]
                i = np.repeat(np.arange(len(held["indptr"]) - 1), np.diff(held["indptr"]))
    except (KeyError, ValueError, OSError):
        return None
    return (i.astype(np.int64), j.astype(np.int64), data) if len(i) == len(j) == len(data) else None


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """path, i, j, w of npz graphs; files that hold none give no rows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                found = graph_edges(content)
                if found:
                    for piece in _pieces(len(found[0])):
                        yield pd.DataFrame({"path": name} | {c: x[piece] for c, x in zip("ijw", found)})

    return _files(spark, path).mapInPandas(rows, "path string, i bigint, j bigint, w double")


def parse_idx(content: bytes) -> np.ndarray:
    """Images (n, pixels) or labels (n) of an IDX file, gzipped or not; ValueError if it isn't a whole one."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    if len(content) < 8:
        raise ValueError("too short for an IDX header")
    magic, n = struct.unpack(">II", content[:8])
    if magic == LABELS:
        shape, start = (n,), 8
    elif magic == IMAGES:
        if len(content) < 16:
            raise ValueError("too short for an IDX image header")
        height, width = struct.unpack(">II", content[8:16])
        shape, start = (n, height * width), 16
    else:
        raise ValueError(f"unknown IDX magic {magic}")
    if len(content) - start != int(np.prod(shape)):
        raise ValueError("IDX length differs from its header")
    return np.frombuffer(content, np.uint8, offset=start).reshape(shape)


def read_idx_images(spark: SparkSession, path: str) -> DataFrame:
    """path, id, pixels (binary)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                images = parse_idx(content)
                for piece in _pieces(len(images)):
                    ids = np.arange(piece.start, piece.stop)
                    yield pd.DataFrame({"path": name, "id": ids, "pixels": [x.tobytes() for x in images[piece]]})

    return _files(spark, path).mapInPandas(rows, "path string, id bigint, pixels binary")


def read_idx_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, id, label."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                labels = parse_idx(content)
                yield pd.DataFrame({"path": name, "id": np.arange(len(labels)), "label": labels.astype(np.int32)})

    return _files(spark, path).mapInPandas(rows, "path string, id bigint, label int")


def write_npy(df: DataFrame, path: str, order: str, value: str) -> None:
    """One column as a local npy file, in the order of another: for results that fit the driver."""
    held = df.select(order, value).orderBy(order).toPandas()[value]
    first = held.iloc[0] if len(held) else 0.0
    np.save(path, np.stack(held.to_numpy()) if isinstance(first, (list, np.ndarray)) else held.to_numpy())
