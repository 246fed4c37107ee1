"""The whole pipeline: vectors to layers of clusters."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import vectors as V
from lamina.operators import embed, graph, hierarchy, initial, knn, layers, spanning
from lamina.session import materialize


@dataclass(frozen=True)
class Params:
    noise_level: float = 0.5
    base_min_cluster_size: int = 5
    base_n_clusters: int | None = None
    approx_n_clusters: int | None = None
    n_neighbors: int = 15
    min_samples: int = 5
    n_epochs: int = 50
    init: str | None = "label_prop"
    symmetrize: bool = True
    dim: int | None = None
    neighbor_scale: float = 1.0
    min_similarity_threshold: float = 0.2
    max_layers: int = 10
    n_label_prop_iter: int = 20
    seed: int = 42
    metric: str = "cosine"
    #: Above so many rows neighbours come from forests and neighbour descent; None: all pairs are searched at any size.
    brute_force_limit: int | None = None
    n_trees: int = 4
    leaf_size: int | None = None
    max_tree_depth: int = 200
    max_candidates: int | None = None
    n_descent_rounds: int | None = None
    delta: float = 0.001
    improvement_delta: float = 1e-4
    #: Up to so many rows, the stages after the neighbour table run over arrays in one task.
    on_one: int = 20_000

    def width(self) -> int:
        return self.dim or min(max(self.n_neighbors // 4, 4), 15)

    @staticmethod
    def parts(n: int) -> int:
        return int(min(max(8 * np.sqrt(n), 256), 16_384))


@dataclass
class Clustering:
    """Tables of a fit: knn, edges, layout (small fits: within layers only), layers."""

    params: Params
    knn: DataFrame
    edges: DataFrame
    layout: DataFrame
    layers: DataFrame

    def labels(self) -> DataFrame:
        return layers.best_layer(self.layers)

    def layer_stats(self) -> DataFrame:
        return layers.layer_stats(self.layers)

    def cluster_tree(self) -> DataFrame:
        return layers.cluster_tree(self.layers)

    def duplicates(self) -> DataFrame:
        return knn.duplicates(self.knn)


def neighbors(rows: DataFrame, params: Params, n: int) -> DataFrame:
    """The neighbour table of n rows."""
    if params.brute_force_limit is None or n <= params.brute_force_limit:
        return knn.TABLES[params.metric][0](rows, params.n_neighbors)
    return knn.knn_approximate(
        rows,
        params.n_neighbors,
        params.metric,
        trees=params.n_trees,
        leaf_size=params.leaf_size,
        depth=params.max_tree_depth,
        candidates=params.max_candidates,
        rounds=params.n_descent_rounds,
        delta=params.delta,
        gain=params.improvement_delta,
        seed=params.seed,
    )


def fit(rows: DataFrame, params: Params = Params()) -> Clustering:
    """Cluster rows (id, vector, dim)."""
    rows = materialize(rows, "vectors")
    n = rows.count()
    table = materialize(neighbors(rows, params, n), "knn")
    k = params.neighbor_scale * min(params.n_neighbors, max(n, 2))
    edges = graph.directed(table, k)
    edges = materialize(graph.fuzzy_union(edges) if params.symmetrize else edges, "edges")
    if n <= params.on_one:
        layout = materialize(_layout_on_one(rows, edges, params), "layout")
    else:
        layout = materialize(_layout(rows, edges, n, params), "layout")
    placed = layout.select("id", F.col("x").alias("vector"), F.size("x").alias("dim"))
    if params.approx_n_clusters:
        found = layers.clusters_by_count(placed, params.approx_n_clusters, params.min_samples)
    elif n <= params.on_one:
        found = _layers_on_one(layout, params)
    else:
        found = layers.cluster_layers(
            placed, params.min_samples, params.base_min_cluster_size, params.base_n_clusters, params.min_similarity_threshold, params.max_layers
        )
    return Clustering(params, table, edges, layout, materialize(found, "layers"))


def _layout(rows: DataFrame, edges: DataFrame, n: int, params: Params) -> DataFrame:
    if params.init == "label_prop":
        start = initial.initial_layout(
            edges, rows, params.width(), Params.parts(n), params.n_label_prop_iter, params.n_epochs, noise=params.noise_level, seed=params.seed
        )
    else:
        start = embed.random_layout(rows, params.width(), params.seed)
    return embed.node_layout(edges, materialize(start, "start"), params.n_epochs, noise=params.noise_level, seed=params.seed, on_one=params.on_one)


def _layout_on_one(rows: DataFrame, edges: DataFrame, params: Params) -> DataFrame:
    def run(points: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("id")
        ids, vectors = points["id"].to_numpy(), np.stack(points["vector"].to_numpy())
        links = links.sort_values(["i", "j"])
        i, j, w = np.searchsorted(ids, links["i"].to_numpy()), np.searchsorted(ids, links["j"].to_numpy()), links["w"].to_numpy()
        n, width = len(ids), params.width()
        if params.init == "label_prop":
            usable = vectors if params.metric == "cosine" else None
            x = initial.initial_arrays(
                i, j, w, usable, n, width, Params.parts(n), params.n_label_prop_iter, params.n_epochs, noise=params.noise_level, seed=params.seed
            )
        else:
            x = np.random.RandomState(params.seed).normal(scale=0.25, size=(n, width))
        top = w.max(initial=0.0)
        eps = params.n_epochs / np.maximum(params.n_epochs * w / top, 1.0) if top > 0 else np.full(len(w), float(params.n_epochs))
        x = embed.layout_arrays(i, j, eps, x, params.n_epochs, embed.ALPHA, params.noise_level, params.seed)
        return pd.DataFrame({"id": ids, "x": list(x)})

    points = rows.select(F.lit(0).alias("one"), "id", "vector").groupBy("one")
    return points.cogroup(edges.select(F.lit(0).alias("single"), "i", "j", "w").groupBy("single")).applyInPandas(run, "id bigint, x array<double>")


def _layers_on_one(layout: DataFrame, params: Params) -> DataFrame:
    """Core distances, tree and layers of a small layout in one task."""

    def run(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("id")
        ids, x = points["id"].to_numpy(), np.stack(points["x"].to_numpy())
        core = np.zeros(len(ids))
        samples = params.min_samples or params.base_min_cluster_size
        if samples > 1:
            for a in range(0, len(ids), 512):
                d2 = ((x[a : a + 512, None, :] - x[None, :, :]) ** 2).sum(axis=2)
                at = min(samples, len(ids) - 1)
                core[a : a + 512] = np.sqrt(np.partition(d2, at, axis=1)[:, at])
        edges = spanning.prim(ids, x, core)
        order = np.lexsort((np.maximum(edges[:, 0], edges[:, 1]), np.minimum(edges[:, 0], edges[:, 1]), edges[:, 2]))
        edges = edges[order]
        merges = hierarchy.linkage(edges[:, 0].astype(int), edges[:, 1].astype(int), edges[:, 2], len(ids))
        found = hierarchy.layers(merges, params.base_min_cluster_size, params.base_n_clusters, params.min_similarity_threshold, params.max_layers)
        return layers.layer_frame(ids, found)

    return layout.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, layers.SCHEMA)


def describe(params: Params) -> dict:
    """Parameters with the values that follow from them."""
    return asdict(params) | {"width": params.width(), "unit_tolerance": V.UNIT_TOLERANCE}
