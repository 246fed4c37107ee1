"""Low-dimensional layout of a graph by attraction along edges and repulsion from drawn vertices.

An epoch is a join of edges with the places at its start, an aggregation of moves, and an update: all
vertices move at once. Which edges fire in an epoch, and how many vertices each draws, follow in closed form from
the weights, so no counters are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import vectors as V
from lamina.session import materialize

from .graph import as_vectors
from .propagate import normal

ALPHA, NOISE = 0.1, 0.5


def schedules(edges: DataFrame, epochs: int) -> DataFrame:
    """edges with eps: epochs between two firings. An edge of greatest weight fires in each epoch."""
    top = edges.agg(F.max("w").alias("top"))  # one row
    share = F.when(F.col("top") > 0, F.greatest(F.lit(float(epochs)) * F.col("w") / F.col("top"), F.lit(1.0))).otherwise(F.lit(1.0))
    return edges.join(F.broadcast(top)).select("i", "j", "w", (F.lit(float(epochs)) / share).alias("eps"))


def fires(eps: Column, n: int) -> Column:
    """Whether an edge fires in epoch n, counted from 0."""
    if n == 0:
        return F.lit(False)
    return F.floor(F.lit(float(n)) / eps + 1e-9) > F.floor(F.lit(float(n - 1)) / eps + 1e-9)


def negatives(eps: Column, n: int, rate: float = 1.0, stretch: float = 1.5) -> Column:
    """How many vertices a firing in epoch n draws: what is due by now, less what was due at the last firing."""
    every = eps * stretch / rate
    due = F.greatest(F.floor(F.lit(float(n)) / every + 1e-9) - 1, F.lit(0))
    # the last firing before n was in the first epoch not before (firings so far - 1) * eps
    last = F.ceil((F.floor(F.lit(float(n)) / eps + 1e-9) - 1) * eps - 1e-9)
    before = F.greatest(F.floor(last / every + 1e-9) - 1, F.lit(0))
    return F.greatest(due - before, F.lit(0)).cast("int")


def epoch(edges: DataFrame, layout: DataFrame, n: int, alpha: float, gamma: float, draw, noise: float = NOISE, numbered: DataFrame | None = None) -> DataFrame:
    """id, x: the move of every vertex in epoch n. edges carry eps.

    draw(i, j, p, count): number of the p-th vertex that an edge draws, from 0 to count - 1. numbered
    gives the vertices their numbers (id, number).
    """
    firing = edges.filter(fires(F.col("eps"), n))
    here = layout.select(F.col("id").alias("i"), F.col("x").alias("a"))
    there = layout.select(F.col("id").alias("j"), F.col("x").alias("b"))
    gap = V.squared_euclidean(F.col("a"), F.col("b"))
    pulled = firing.join(here, "i").join(there, "j").withColumn("d2", gap).filter("d2 > 0")
    pull = (-2.0 * noise * F.sqrt("d2") - 2.0) / (2.0 * F.col("d2") - 0.5 * F.sqrt("d2") + 1.0)
    moves = pulled.select(F.col("i").alias("id"), F.zip_with("a", "b", lambda x, y: alpha * pull * (x - y)).alias("m"))
    if numbered is not None:
        count = numbered.agg(F.count("*").alias("vertices"))  # one row
        drawn = firing.withColumn("draws", negatives(F.col("eps"), n)).filter("draws > 0")
        drawn = drawn.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("draws") - 1))).join(F.broadcast(count))
        drawn = drawn.select("i", draw(F.col("i"), F.col("j"), F.col("p"), F.col("vertices")).alias("number")).join(numbered.withColumnRenamed("id", "j"), "number")
        pushed = drawn.join(here, "i").join(there, "j").withColumn("d2", gap).filter("d2 > 0.01")
        push = gamma * 4.0 / ((1.0 + 0.25 * F.col("d2")) * F.greatest("d2", F.lit(0.01)))  # may be evaluated before the filter
        moves = moves.unionByName(pushed.select(F.col("i").alias("id"), F.zip_with("a", "b", lambda x, y: alpha * V.clip(push * (x - y), -4.0, 4.0)).alias("m")))
    return as_vectors(moves.select("id", F.posexplode("m").alias("pos", "value")).groupBy("id", "pos").agg(F.sum("value").alias("value")))


def learning_rates(epochs: int, alpha: float) -> list[float]:
    """Of each epoch: the first two have the full rate."""
    return [alpha * (1 - max(n - 1, 0) / epochs) for n in range(epochs)]


def repulsions(epochs: int) -> list[float]:
    return [1.0] if epochs == 1 else [0.5 + n / (epochs - 1) for n in range(epochs)]


def hashed_draw(seed: int, n: int):
    return lambda i, j, p, count: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), i, j, p), count)


def random_layout(ids: DataFrame, width: int, seed: int, scale: float = 0.25) -> DataFrame:
    return ids.select("id", F.array(*[scale * normal(F.lit(seed), F.col("id"), F.lit(c)) for c in range(width)]).alias("x"))


def node_layout(edges: DataFrame, start: DataFrame, epochs: int, alpha: float = ALPHA, noise: float = NOISE, seed: int = 42, on_one: int = 50_000) -> DataFrame:
    """id, x after so many epochs, from the places in start.

    Up to on_one vertices one task runs all epochs over arrays; beyond that each epoch is a job whose
    result is written. Both take the same steps.
    """
    timed = schedules(edges, epochs)
    if start.count() <= on_one:
        return _on_one(timed, start, epochs, alpha, noise, seed)
    from .propagate import _dense

    numbered = materialize(_dense(start.select("id"), "id", "number"), "numbers")
    timed, layout = materialize(timed, "timed"), materialize(start.select("id", "x", F.transform("x", lambda x: x * 0.0).alias("u")), "layout")
    for n, (rate, gamma) in enumerate(zip(learning_rates(epochs, alpha), repulsions(epochs))):
        moves = epoch(timed, layout.select("id", "x"), n, rate, gamma, hashed_draw(seed, n), noise, numbered).withColumnRenamed("x", "m")
        moved = layout.join(moves, "id", "left").withColumn("u", F.when(F.col("m").isNull(), F.col("u")).otherwise(F.zip_with("u", "m", lambda a, b: a + b)))
        decay = 0.5 * (1 - rate) ** 2
        layout = materialize(
            moved.select("id", F.zip_with("x", "u", lambda a, b: a + b).alias("x"), F.transform("u", lambda u: u * decay).alias("u")), "layout"
        )
    return layout.select("id", "x")


def mix64(*keys: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of integer keys."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for key in keys:
            h = (np.asarray(key).astype(np.uint64) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return h


def layout_arrays(i, j, eps, x, epochs, alpha, noise, seed):
    """The epochs over arrays; i and j are numbers of vertices, in order of i, j."""
    x, count = x.copy(), len(x)
    u = np.zeros_like(x)
    every = eps * 1.5
    for n, (rate, gamma) in enumerate(zip(learning_rates(epochs, alpha), repulsions(epochs))):
        if n:
            fire = np.flatnonzero(np.floor(n / eps + 1e-9) > np.floor((n - 1) / eps + 1e-9))
            a, b, e, f = i[fire], j[fire], eps[fire], every[fire]
            gap = x[a] - x[b]
            d2 = (gap * gap).sum(axis=1)
            d = np.sqrt(d2)
            pull = np.where(d2 > 0, (-2 * noise * d - 2) / (2 * d2 - 0.5 * d + 1), 0.0)
            np.add.at(u, a, rate * pull[:, None] * gap)
            due = np.maximum(np.floor(n / f + 1e-9) - 1, 0)
            last = np.ceil((np.floor(n / e + 1e-9) - 1) * e - 1e-9)
            draws = np.maximum(due - np.maximum(np.floor(last / f + 1e-9) - 1, 0), 0).astype(int)
            of = np.repeat(np.arange(len(fire)), draws)
            p = np.arange(len(of)) - np.repeat(np.cumsum(draws) - draws, draws)
            other = (mix64(seed, n, a[of], b[of], p) % np.uint64(count)).astype(np.int64)
            gap = x[a[of]] - x[other]
            d2 = (gap * gap).sum(axis=1)
            push = np.where(d2 > 0.01, gamma * 4 / ((1 + 0.25 * d2) * np.maximum(d2, 0.01)), 0.0)
            np.add.at(u, a[of], rate * np.clip(push[:, None] * gap, -4, 4))
        x += u
        u *= 0.5 * (1 - rate) ** 2
    return x


def _on_one(timed: DataFrame, start: DataFrame, epochs: int, alpha: float, noise: float, seed: int) -> DataFrame:
    import pandas as pd

    rows = start.select(F.lit(0).alias("one"), "id", "x").groupBy("one")
    links = timed.select(F.lit(0).alias("single"), "i", "j", "eps").groupBy("single")

    def run(places: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        places = places.sort_values("id")
        ids, x = places["id"].to_numpy(), np.stack(places["x"].to_numpy())
        edges = edges.sort_values(["i", "j"])
        i, j = (np.searchsorted(ids, edges[c].to_numpy()) for c in ("i", "j"))
        x = layout_arrays(i, j, edges["eps"].to_numpy(), x, epochs, alpha, noise, seed)
        return pd.DataFrame({"id": ids, "x": list(x)})

    return rows.cogroup(links).applyInPandas(run, "id bigint, x array<double>")
