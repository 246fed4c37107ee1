"""Minimum spanning trees under mutual reachability, as tables (a, b, w) with a < b.

The order of edges is total, (w, a, b), so the tree is unique. Up to on_one rows one task grows the tree over
blocks of distances; beyond that one blocked search lists the nearest rows of each, each component takes its least
outgoing edge, and components along these edges merge. A listed edge is taken if it is less than any that lists may lack; when
no component has such a one, the rows that may have a lesser edge are searched, but for those of the largest component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import materialize

from . import blocks, knn
from .components import components


#: Links whose components one task finds; more are joined.
LINKS = 1_000_000
#: Neighbours of a row that are listed at first, and rows that a search compares with a shard at once.
LISTED, SEARCHED = 16, 256
#: Listed neighbours of all rows that one task joins; more are joined by jobs.
ARRAYS = 4_000_000


def distances(columns: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances of vectors (one a column) from a point. Squares are added in the order of the components, as
    those of core distances are, so that edges as long as a core distance are exactly so and ties are broken by ids."""
    total = np.zeros(columns.shape[1])
    for column, x in zip(columns, point.tolist()):
        gap = column - x
        total += gap * gap
    return np.sqrt(total)


def prim(ids: np.ndarray, rows: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (place, place, w) of the tree over rows in order of ids."""
    n = len(ids)
    best, source = np.full(n, np.inf), np.zeros(n, np.int64)
    outside = np.ones(n, bool)
    edges = np.zeros((max(0, n - 1), 3))
    now, columns = 0, np.ascontiguousarray(rows.T)
    for step in range(n - 1):
        outside[now] = False
        reach = np.maximum(distances(columns, rows[now]), np.maximum(core, core[now]))
        # of equal weights the edge of least (a, b) wins
        here, there = np.minimum(np.arange(n), now), np.maximum(np.arange(n), now)
        held = np.minimum(np.arange(n), source), np.maximum(np.arange(n), source)
        nearer = (reach < best) | ((reach == best) & ((here < held[0]) | ((here == held[0]) & (there < held[1]))))
        nearer &= outside
        best[nearer], source[nearer] = reach[nearer], now
        some = np.flatnonzero(outside)
        least = some[best[some] == best[some].min()]
        low, high = np.minimum(least, source[least]), np.maximum(least, source[least])
        now = int(least[np.lexsort((high, low))[0]])
        edges[step] = (source[now], now, best[now])
    return edges


def spanning_tree(rows: DataFrame, min_samples: int = 1, on_one: int = 20_000) -> DataFrame:
    """a, b, w of the tree over rows (id, vector); core distances are those of neighbour number min_samples."""
    if rows.count() <= on_one:
        return _on_one(rows.join(knn.core_distances(rows, min_samples), "id").select("id", "vector", "core"))
    return boruvka(rows, min_samples)


def _on_one(cored: DataFrame) -> DataFrame:
    def grow(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("id")
        ids = batch["id"].to_numpy()
        edges = prim(ids, np.stack(batch["vector"].to_numpy()), batch["core"].to_numpy())
        one, two = ids[edges[:, 0].astype(int)], ids[edges[:, 1].astype(int)]
        return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two), "w": edges[:, 2]})

    return cored.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(grow, "a bigint, b bigint, w double")


def nearest_outside(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """i, j, w: for each row of asked its nearest row of another component; rows and asked: id, vector, core, comp."""

    def packed(some: DataFrame) -> DataFrame:
        some = some.select("id", F.concat("vector", F.array("core", F.col("comp").cast("double"))).alias("vector"))
        return some.withColumn("dim", F.size("vector"))

    def kernel(ids, matrix, query_ids, queries):
        found, others, scores = [], [], []
        vectors, core, comp = matrix[:, :-2], matrix[:, -2], matrix[:, -1]
        squares = (vectors * vectors).sum(axis=1)
        for start in range(0, len(queries), SEARCHED):
            some = queries[start : start + SEARCHED]
            own = (some[:, :-2] ** 2).sum(axis=1)[:, None]
            rough = np.maximum(squares + own - 2 * some[:, :-2] @ vectors.T, np.maximum(core, some[:, -2:-1]) ** 2)
            rough[comp == some[:, -1:]] = np.inf
            slack = 1e-9 * max(1.0, float(squares.max(initial=0)), float(own.max(initial=0)))
            for i, query, far in zip(query_ids[start : start + SEARCHED].tolist(), some, rough):
                able = np.flatnonzero(far <= far.min() + slack)
                if not np.isfinite(far[able[0]]):
                    continue
                reach = np.maximum(distances(np.ascontiguousarray(vectors[able].T), query[:-2]), np.maximum(core[able], query[-2]))
                found.append(i)
                others.append(ids[able][reach == reach.min()].min())
                scores.append(-reach.min())
        return np.array(found, np.int64), np.array(others, np.int64), np.array(scores)

    near = blocks.search(packed(rows), packed(asked), kernel, 1, "double")
    return near.select(F.col("query_id").alias("i"), F.col("vec_id").alias("j"), (-F.col("score")).alias("w"))


def _edges(near: DataFrame, state: DataFrame) -> DataFrame:
    """a, b, w and x, y, the components of a and b, of edges i, j, w."""
    near = near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "w").distinct()
    one, two = (state.select(F.col("id").alias(s), F.col("comp").alias(c)) for s, c in (("a", "x"), ("b", "y")))
    return near.join(one, "a").join(two, "b").select("a", "b", "w", "x", "y").filter("x <> y")


def _merged(links: DataFrame, on_one: int = LINKS) -> DataFrame:
    """node, component (the least node reachable) of written links (a, b)."""
    if links.count() > on_one:
        return components(links)

    def run(held: pd.DataFrame) -> pd.DataFrame:
        nodes, ends = np.unique(held[["a", "b"]].to_numpy(), return_inverse=True)
        top = _tops(np.arange(len(nodes)), *ends.reshape(-1, 2).T)
        return pd.DataFrame({"node": nodes, "component": nodes[top]})

    return links.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "node bigint, component bigint")


def _tops(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the least that links a, b and its own top reach; top: the least node of each one's component."""
    while (top[a] != top[b]).any():
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        np.minimum.at(top, high, low)
        while (top[top] != top).any():
            top = top[top]
    return top


def joined(least: np.ndarray, own: np.ndarray, other: np.ndarray, w: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the edges taken, the component of each row, and the rows to be searched next (none: the tree is done).

    own, other: places of the ends of edges, own that of the row that lists it; least: edges of a row that it doesn't list weigh
    no less; step: 0 for listed edges, else the number of the search that found it. Each call does all rounds again, those
    after a search with what it found.
    """
    order = np.lexsort((np.maximum(own, other), np.minimum(own, other), w))
    own, other, w, step = own[order], other[order], w[order], step[order]
    n, none, searches = len(least), len(w), int(step.max(initial=0))
    comp, least, taken, now = np.arange(n), least.copy(), [], 0
    live = np.arange(none)

    def firsts() -> np.ndarray:
        """For each component its least known edge that leaves it."""
        some, first = live[step[live] <= now], np.full(n, none)
        for ends in (own, other):
            np.minimum.at(first, comp[ends[some]], some)
        return first

    while True:
        live = live[comp[own[live]] != comp[other[live]]]
        first = firsts()
        at = np.append(w, np.inf)[first]
        # a found edge is the very least of its row while it leaves the component; after that others may be as long
        bound, met = least.copy(), live[(step[live] > 0) & (step[live] <= now)]
        met = met[w[met] == least[own[met]]]
        bound[own[met]] = np.nextafter(w[met], np.inf)
        lacking = np.full(n, np.inf)
        np.minimum.at(lacking, comp, bound)
        chosen = np.unique(first[(first < none) & (at < lacking)])
        if not len(chosen):
            largest = int(np.bincount(comp, minlength=1).argmax())
            asked = np.flatnonzero((comp != largest) & (bound <= at[comp]) & (bound < np.inf))
            if not len(asked) or now == searches:
                break
            now += 1
            new = np.flatnonzero(step == now)
            least[asked] = np.inf
            least[own[new]] = w[new]
            first = firsts()
            first[largest] = none
            chosen = np.unique(first[first < none])
            if not len(chosen):
                asked = asked[:0]
                break
        taken.append(chosen)
        comp = _tops(comp, own[chosen], other[chosen])
    return order[np.concatenate([np.zeros(0, np.int64), *taken])], comp, asked


def _by_arrays(rows: DataFrame, points: DataFrame, near: DataFrame) -> DataFrame:
    """The tree, its rounds in one task and only searches of rows as jobs; points: id, core, least; near: i, j, d."""

    def run(held: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("id")
        ids, core = held["id"].to_numpy(), held["core"].to_numpy()
        i, j = np.searchsorted(ids, links["i"].to_numpy()), np.searchsorted(ids, links["j"].to_numpy())
        w = np.maximum(links["d"].to_numpy(), np.maximum(core[i], core[j]))
        taken, comp, asked = joined(held["least"].to_numpy(), i, j, w, links["step"].to_numpy())
        again = np.zeros(len(ids))
        again[asked] = 1
        tree = pd.DataFrame({"edge": True, "a": ids[np.minimum(i, j)[taken]], "b": ids[np.maximum(i, j)[taken]], "w": w[taken]})
        return pd.concat([tree, pd.DataFrame({"edge": False, "a": ids, "b": ids[comp], "w": again})])

    links, step = near.select("i", "j", "d", F.lit(0).alias("step")), 0
    while True:
        both = points.withColumn("one", F.lit(0)).groupBy("one").cogroup(links.withColumn("single", F.lit(0)).groupBy("single"))
        found = materialize(both.applyInPandas(run, "edge boolean, a bigint, b bigint, w double"), "found")
        again = found.filter("not edge and w > 0").select(F.col("a").alias("id"))
        if not again.limit(1).count():
            return found.filter("edge").select("a", "b", "w")
        step += 1
        comps = found.filter("not edge").select(F.col("a").alias("id"), F.col("b").alias("comp"))
        placed = materialize(rows.join(points.select("id", "core"), "id").join(comps, "id").select("id", "vector", "core", "comp"), "placed")
        more = nearest_outside(placed, materialize(placed.join(again, "id"), "asked"))
        links = links.unionByName(materialize(more.select("i", "j", F.col("w").alias("d"), F.lit(step).alias("step")), "more"))


def boruvka(rows: DataFrame, min_samples: int = 1, listed: int = LISTED, arrays: int = ARRAYS) -> DataFrame:
    """Rounds of least outgoing edges until one component is left; rows: id, vector.

    One search gives lists and core distances. Edges to rows that a list lacks are no less than the core distance of its row
    and the distance of its last entry.
    """
    listed = max(listed, min_samples)
    rows = materialize(rows.select("id", "vector").withColumn("dim", F.size("vector")), "rows")
    found = knn.euclidean_search(rows, listed)
    near = materialize(found.select(F.col("query_id").alias("i"), "rank", F.col("vec_id").alias("j"), F.sqrt(-F.col("score")).alias("d")), "listed")
    held = near.groupBy(F.col("i").alias("id")).agg(
        F.max(F.when(F.col("rank") <= min_samples, F.col("d"))).alias("core"), F.when(F.count("*") >= listed, F.max("d")).alias("d")
    )
    core = F.coalesce("core", F.lit(0.0)) if min_samples > 1 else F.lit(0.0)
    points = rows.select("id").join(held, "id", "left").select("id", core.alias("core"), F.coalesce("d", F.lit(float("inf"))).alias("d"))
    points = materialize(points.select("id", "core", F.greatest("core", "d").alias("least")), "points")
    if near.count() <= arrays:
        return _by_arrays(rows, points, near)
    return _by_jobs(rows, points, near)


def _by_jobs(rows: DataFrame, points: DataFrame, near: DataFrame) -> DataFrame:
    """The tree, its rounds as joins and aggregations; points: id, core, least; near: i, j, d."""
    rows = materialize(rows.join(points.select("id", "core"), "id"), "rows")
    state = materialize(points.select("id", F.col("id").alias("comp"), "core", "least"), "state")
    one, two = (state.select(F.col("id").alias(s), F.col("core").alias(f"core_{s}")) for s in "ij")
    reach = near.join(one, "i").join(two, "j").select("i", "j", F.greatest("d", "core_i", "core_j").alias("w"))
    edges, tree = materialize(_edges(reach, state), "edges"), None
    edge = F.struct("w", "a", "b", "x", "y")
    while True:
        ends = edges.select(F.col("x").alias("comp"), edge.alias("e")).unionByName(edges.select(F.col("y").alias("comp"), edge.alias("e")))
        best = state.groupBy("comp").agg(F.min("least").alias("lacking"), F.count("*").alias("n")).join(ends.groupBy("comp").agg(F.min("e").alias("e")), "comp", "left")
        best = materialize(best, "best")
        chosen = materialize(best.filter("e.w < lacking").select("e.*").distinct(), "chosen")
        if not chosen.limit(1).count():
            largest = best.orderBy(F.desc("n"), "comp").limit(2).collect()
            if len(largest) < 2:
                break
            others = best.filter(F.col("comp") != largest[0]["comp"])
            able = state.join(others.select("comp", "e"), "comp").filter("e is null or least <= e.w").select("id")
            placed = materialize(rows.join(state.select("id", "comp"), "id"), "placed")
            asked = materialize(placed.join(able, "id"), "asked")
            more = _edges(nearest_outside(placed, asked), state)
            more = more.select(F.col("x").alias("comp"), edge.alias("e")).unionByName(more.select(F.col("y").alias("comp"), edge.alias("e")))
            more = more.join(others.select("comp"), "comp").unionByName(others.filter("e is not null").select("comp", "e"))
            chosen = materialize(more.groupBy("comp").agg(F.min("e").alias("e")).select("e.*").distinct(), "chosen")
            if not chosen.limit(1).count():
                break
        tree = chosen.select("a", "b", "w") if tree is None else tree.unionByName(chosen.select("a", "b", "w"))
        merged = materialize(_merged(chosen.select(F.col("x").alias("a"), F.col("y").alias("b"))), "merged")

        def renamed(held: DataFrame, name: str) -> DataFrame:
            into = merged.select(F.col("node").alias(name), "component")
            return held.join(into, name, "left").withColumn(name, F.coalesce("component", name)).drop("component")

        state = materialize(renamed(state, "comp"), "state")
        edges = materialize(renamed(renamed(edges, "x"), "y").filter("x <> y"), "edges")
    return tree if tree is not None else rows.sparkSession.createDataFrame([], "a bigint, b bigint, w double")


def components_at(tree: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """id, component: the least id that edges of at most threshold reach."""
    found = _merged(materialize(tree.filter(F.col("w") <= threshold).select("a", "b"), "short"))
    return ids.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
