"""Cluster layers of a layout as tables, and the tree between layers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hierarchy, spanning

SCHEMA = "layer int, id bigint, label bigint, strength double, persistence double"


def linkage_of(tree: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    """Merges of a spanning tree (a, b, w) over sorted ids."""
    tree = tree.sort_values(["w", "a", "b"], kind="stable")
    a, b = np.searchsorted(ids, tree["a"].to_numpy()), np.searchsorted(ids, tree["b"].to_numpy())
    return hierarchy.linkage(a, b, tree["w"].to_numpy(), len(ids))


def on_tree(tree: DataFrame, ids: DataFrame, cut, schema: str) -> DataFrame:
    """What cut(ids, merges) returns for a spanning tree: one row a point reaches one task."""
    points = ids.select(F.lit(0).alias("one"), "id").groupBy("one")
    edges = tree.select(F.lit(0).alias("single"), "a", "b", "w").groupBy("single")

    def run(held: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(held["id"].to_numpy())
        return cut(own, linkage_of(links, own))

    return points.cogroup(edges).applyInPandas(run, schema)


def layer_frame(ids: np.ndarray, found: list[hierarchy.Layer]) -> pd.DataFrame:
    parts = [
        pd.DataFrame({"layer": n, "id": ids, "label": layer.label, "strength": layer.strength, "persistence": layer.persistence})
        for n, layer in enumerate(found)
    ]
    return pd.concat(parts) if parts else pd.DataFrame(columns=["layer", "id", "label", "strength", "persistence"])


def cluster_layers(rows: DataFrame, min_samples: int = 5, min_size: int = 5, base_clusters: int | None = None, limit: float = 0.2, most: int = 10) -> DataFrame:
    """layer, id, label, strength, persistence: layers of rows (id, vector), finest first; -1 is noise."""

    def cut(ids: np.ndarray, merges: np.ndarray) -> pd.DataFrame:
        return layer_frame(ids, hierarchy.layers(merges, min_size, base_clusters, limit, most))

    return on_tree(spanning.spanning_tree(rows, min_samples or min_size), rows, cut, SCHEMA)


def clusters_by_count(rows: DataFrame, wanted: int, min_samples: int = 5) -> DataFrame:
    """One layer of about so many clusters."""

    def cut(ids: np.ndarray, merges: np.ndarray) -> pd.DataFrame:
        tree, chosen, label = hierarchy.by_count(merges, wanted)
        return layer_frame(ids, [hierarchy.Layer(label, hierarchy.strengths(tree, chosen, label), 0.0)])

    return on_tree(spanning.spanning_tree(rows, min_samples), rows, cut, SCHEMA)


def layer_stats(layers: DataFrame) -> DataFrame:
    found = layers.groupBy("layer").agg(
        F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"),
        F.sum((F.col("label") < 0).cast("int")).alias("n_noise"),
        F.max("persistence").alias("persistence"),
    )
    return found


def best_layer(layers: DataFrame) -> DataFrame:
    """id, label, strength of the layer of greatest persistence; the last of equals."""
    best = layers.groupBy().agg(F.max(F.struct("persistence", "layer"))["layer"].alias("layer"))
    return layers.join(F.broadcast(best), "layer").select("id", "label", "strength")


def cluster_tree(layers: DataFrame) -> DataFrame:
    """parent_layer, parent_cluster, child_layer, child_cluster.

    A cluster hangs on the nearest coarser layer with a cluster that shares a point with it, and there on
    the one of least label; clusters without one hang on (number of layers, 0).
    """
    own = layers.filter("label >= 0").select("id", F.col("layer").alias("child_layer"), F.col("label").alias("child_cluster"))
    up = layers.filter("label >= 0").select("id", F.col("layer").alias("parent_layer"), F.col("label").alias("parent_cluster"))
    shared = own.join(up, "id").filter("parent_layer > child_layer")
    child = ["child_layer", "child_cluster"]
    found = shared.groupBy(child).agg(F.min(F.struct("parent_layer", "parent_cluster")).alias("p"))
    top = layers.agg((F.max("layer") + 1).alias("top"))  # one row
    every = own.select(child).distinct().join(found, child, "left").join(F.broadcast(top))
    return every.select(F.coalesce("p.parent_layer", "top").alias("parent_layer"), F.coalesce("p.parent_cluster", F.lit(0)).cast("bigint").alias("parent_cluster"), *child)
