"""Approximate neighbour tables: random-projection forests refined by neighbour descent.

Every step is a join or an aggregation over (i, j) rows; draws are hashes, so a seed fixes the result
however rows are dealt. Leaves and candidate lists have a bounded size.

Vectors are unit vectors (``cosine``), integers (``int8``) or packed words of 32 bits (``bits``); a metric is what a pair
scores, greater being nearer, and on which side of two rows a third one lies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import vectors as V
from lamina.session import materialize

from . import blocks, knn

#: Rounds end when so small a share of the entries is new, or the summed scores grow by less than GAIN of themselves.
DELTA, GAIN, DEPTH = 0.001, 1e-4, 200
#: Share of the true neighbours that CHECKED rows, searched exactly, must have; lists start at WIDE times k and double until they do.
RECALL, CHECKED, WIDE = 0.93, 256, 3
#: Rows whose candidates one group of a round holds, and rows of a leaf unless lists are longer.
GROUP_ROWS, LEAF_ROWS = 256, 512


def _dot(x: Column, y: Column) -> Column:
    return V.dot(x, y)


def _overlap(x: Column, y: Column) -> Column:
    """Share of common bits among the bits of either."""
    words = [F.transform(v, lambda w: w.cast("bigint")) for v in (x, y)]
    return -V.jaccard_raw(*words)


def _plane(x: Column, a: Column, b: Column) -> Column:
    """Above 0 on the side of a: the product with a - b."""
    return V.dot(x, a) - V.dot(x, b)


def _common(x: Column, a: Column, b: Column) -> Column:
    """Above 0 where x shares more bits with what a has alone than with what b has alone."""
    x, a, b = (F.transform(v, lambda w: w.cast("bigint")) for v in (x, a, b))

    def shared(one: Column, other: Column) -> Column:
        alone = F.zip_with(one, other, lambda p, q: p.bitwiseAND(F.bitwise_not(q)))
        return F.aggregate(F.zip_with(x, alone, lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda s, z: s + z)

    return (shared(a, b) - shared(b, a)).cast("double")


SCORES = {"cosine": _dot, "int8": _dot, "bits": _overlap}
MARGINS = {"cosine": _plane, "int8": _plane, "bits": _common}


def forest(rows: DataFrame, leaf_size: int = 15, trees: int = 4, seed: int = 42, depth: int = DEPTH, metric: str = "cosine") -> DataFrame:
    """tree, leaf, id: each tree splits rows (id, vector) until leaves have at most leaf_size rows.

    A node splits by the side of the plane halfway between two of its rows, those of least and greatest hash (of bits: by
    the bits that only one of the two has). Rows on the plane go either way by hash, as all do where the two are equal.
    """
    placed = rows.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit("").alias("leaf"))
    done, open_ = None, materialize(placed, "nodes")
    for level in range(depth):
        sizes = open_.groupBy("tree", "leaf").agg(
            F.count("*").alias("n"),
            F.min_by("vector", F.xxhash64(F.lit(seed), F.lit(level), "tree", "id")).alias("a"),
            F.max_by("vector", F.xxhash64(F.lit(seed), F.lit(level), "tree", "id")).alias("b"),
        )
        at = open_.join(sizes, ["tree", "leaf"])
        small = materialize(at.filter(F.col("n") <= leaf_size).select("tree", "leaf", "id"), "leaves")
        done = small if done is None else done.unionByName(small)
        margin = MARGINS[metric](F.col("vector"), F.col("a"), F.col("b"))
        coin = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.lit("coin"), "tree", "id"), F.lit(2)) == 0
        side = F.when(F.abs("margin") < 1e-8, coin).otherwise(F.col("margin") > 0)
        large = at.filter(F.col("n") > leaf_size).withColumn("margin", margin)
        open_ = materialize(large.select("id", "vector", "tree", F.concat("leaf", F.when(side, "1").otherwise("0")).alias("leaf")), "nodes")
        if not open_.limit(1).count():
            break
    return done


def _scored(pairs: DataFrame, rows: DataFrame, metric: str) -> DataFrame:
    """i, j, sim for distinct pairs."""
    a, b = rows.select(F.col("id").alias("i"), F.col("vector").alias("a")), rows.select(F.col("id").alias("j"), F.col("vector").alias("b"))
    return pairs.join(a, "i").join(b, "j").select("i", "j", SCORES[metric](F.col("a"), F.col("b")).alias("sim"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def random_fill(current: DataFrame, rows: DataFrame, k: int, seed: int, metric: str = "cosine") -> DataFrame:
    """current with rows of fewer than k neighbours filled up by rows that hashes draw."""
    from .propagate import _dense

    numbered = materialize(_dense(rows.select("id"), "id", "number"), "numbers")
    count = numbered.count()
    held = rows.select(F.col("id").alias("i")).join(current.groupBy("i").agg(F.count("*").alias("n")), "i", "left")
    short = held.filter(F.coalesce("n", F.lit(0)) < k).select("i", F.explode(F.sequence(F.lit(1), F.lit(2 * k))).alias("p"))
    drawn = short.select("i", F.pmod(F.xxhash64(F.lit(seed), "i", "p"), F.lit(count)).alias("number")).join(numbered, "number")
    fresh = drawn.select("i", F.col("id").alias("j")).filter("i <> j").distinct().join(current.select("i", "j"), ["i", "j"], "left_anti")
    return _best(current.drop("rank").unionByName(_scored(fresh, rows, metric)), k)


def _scores(metric: str, vectors: np.ndarray) -> np.ndarray:
    """Scores of all pairs, added in the order of the components as those of columns are."""
    out = np.zeros((len(vectors),) * 2)
    if metric != "bits":
        for x in vectors.T.astype(float):
            out += x[:, None] * x
        return out
    either = np.zeros_like(out)
    for w in vectors.T.astype(np.int64):
        out += np.bitwise_count(w[:, None] & w)
        either += np.bitwise_count(w[:, None] | w)
    return np.divide(out, either, out=np.zeros_like(out), where=either > 0)


def _meetings(picked: DataFrame, rows: DataFrame, least: DataFrame | None, k: int, groups: int, metric: str) -> DataFrame:
    """i, j, sim: pairs of candidates (v, u, new) that share a v, one of them new, that may be among the k best of i.

    Candidates of a v are bounded, and those of several v meet in a task, which lets out the k best of each i that score at
    least what least (u, least) has for it.
    """
    held = picked.join(rows.select(F.col("id").alias("u"), "vector"), "u")
    held = held.withColumn("least", F.lit(None).cast("double")) if least is None else held.join(least, "u", "left")
    held = held.select(F.pmod(F.xxhash64("v"), F.lit(groups)).alias("part"), "v", "u", "new", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("v", "ascending"), ("u", "ascending")])
        v, u, fresh, least = (table.column(c).to_numpy() for c in ("v", "u", "new", "least"))
        ids, place = np.unique(u, return_inverse=True)
        matrix = blocks.matrix(table)
        cuts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1], [True])))
        pairs, scores = [], []
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            new, own = fresh[low:high], place[low:high]
            score = _scores(metric, matrix[low:high])
            able = (score >= least[low:high, None]) & (new[:, None] | new)
            np.fill_diagonal(able, False)
            i, j = np.nonzero(able)
            pairs.append(own[i] * len(ids) + own[j])
            scores.append(score[i, j])
        pair, first = np.unique(np.concatenate(pairs), return_index=True)
        one, two = np.divmod(pair, len(ids))
        score = np.concatenate(scores)[first]
        order = np.lexsort((two, -score, one))
        one = one[order]
        best = np.arange(len(one)) - np.searchsorted(one, one) < k
        return pa.table({"i": ids[one[best]], "j": ids[two[order][best]], "sim": score[order][best]})

    held = held.repartition(min(groups, 512), "part")  # by number, as the work is far greater than the size
    return held.groupBy("part").applyInArrow(meet, "i bigint, j bigint, sim double").dropDuplicates(["i", "j"])


def recall_of(found: DataFrame, rows: DataFrame, k: int, seed: int = 42, metric: str = "cosine", checked: int = CHECKED) -> float:
    """Share of the k nearest rows, by an exact search for some rows that hashes draw, which found (i, j) holds; 1 if there are none."""
    rows = rows.select("id", "vector", F.size("vector").alias("dim"))
    some = materialize(rows.orderBy(F.xxhash64(F.lit(seed), F.lit("checked"), "id"), "id").limit(checked), "checked")
    kernel = knn.jaccard_kernel(k) if metric == "bits" else knn.inner_product_kernel(k)
    true = blocks.search(rows, some, kernel, k, "double").select(F.col("query_id").alias("i"), F.col("vec_id").alias("j"))
    hits = true.join(found.select("i", "j", F.lit(1).alias("hit")), ["i", "j"], "left").agg(F.count("*"), F.count("hit")).first()
    return hits[1] / hits[0] if hits[0] else 1.0


def neighbor_descent(
    rows: DataFrame,
    k: int = 15,
    trees: int = 4,
    rounds: int | None = None,
    seed: int = 42,
    candidates: int | None = None,
    metric: str = "cosine",
    leaf_size: int | None = None,
    depth: int = DEPTH,
    delta: float = DELTA,
    gain: float = GAIN,
    recall: float = RECALL,
) -> DataFrame:
    """i, rank, j, sim: about the k nearest rows of each, without itself, by the metric's score.

    Lists are wider than k, as those of k alone end in dead ends where vectors have no structure. Each round takes of every
    row the candidates new and old neighbours, forward and reverse, that hashes draw, and scores pairs with a new one that
    share a row. Rounds end when hardly a neighbour changes (delta) or the scores of all hardly grow (gain). Then some rows are
    searched exactly; if less than recall of their neighbours were found, lists and candidates double and rounds go on.
    """
    rows = materialize(rows.select("id", "vector"), "vectors")
    n = rows.count()
    wide, most = max(1, min(WIDE * k, n - 1)), candidates or min(60, max(1, int(1.5 * k)))
    leaves = forest(rows, leaf_size or max(LEAF_ROWS, k), trees, seed, depth, metric)
    placed = leaves.select(F.xxhash64("tree", "leaf").alias("v"), F.col("id").alias("u"), F.lit(True).alias("new"))
    near = _best(_meetings(placed, rows, None, wide, math.ceil(trees * n / 8 / LEAF_ROWS), metric), wide)
    current = materialize(random_fill(near, rows, wide, seed, metric).withColumn("new", F.lit(True)), "current")
    turn = 0
    while True:
        current, turn = _rounds(current, rows, n, wide, most, turn, rounds or max(5, round(math.log2(max(n, 2)))), seed, metric, delta, gain)
        found = current.filter(F.col("rank") <= k).select("i", "rank", "j", "sim")
        if wide >= n - 1 or recall_of(found, rows, k, seed, metric) >= recall:
            return found
        wide, most = min(2 * wide, n - 1), 2 * most
        current = current.withColumn("new", F.lit(True))


def _rounds(current: DataFrame, rows: DataFrame, n: int, k: int, most: int, turn: int, rounds: int, seed: int, metric: str, delta: float, gain: float) -> tuple[DataFrame, int]:
    """Lists of k (i, j, sim, rank, new) after up to so many rounds, and the number of the next round."""
    total = current.agg(F.sum("sim")).first()[0] or 0.0
    for turn in range(turn, turn + rounds):
        both = current.select(F.col("i").alias("v"), F.col("j").alias("u"), "new").unionByName(current.select(F.col("j").alias("v"), F.col("i").alias("u"), "new"))
        both = both.groupBy("v", "u").agg(F.max("new").alias("new"))
        draw = Window.partitionBy("v", "new").orderBy(F.xxhash64(F.lit(seed), F.lit(turn), "v", "u"))
        picked = materialize(both.withColumn("r", F.row_number().over(draw)).filter(F.col("r") <= most).drop("r"), "picked")
        least = current.groupBy(F.col("i").alias("u")).agg(F.when(F.count("*") >= k, F.min("sim")).alias("least"))
        met = _meetings(picked, rows, least, k, math.ceil(n / GROUP_ROWS), metric).join(current.select("i", "j"), ["i", "j"], "left_anti")
        tried = picked.filter("new").select(F.col("v").alias("i"), F.col("u").alias("j"), F.lit(True).alias("tried"))
        kept = current.join(tried, ["i", "j"], "left").select("i", "j", "sim", (F.col("new") & F.col("tried").isNull()).alias("new"), F.lit(False).alias("fresh"))
        merged = kept.unionByName(met.withColumn("new", F.lit(True)).withColumn("fresh", F.lit(True)))
        current = materialize(_best(merged, k), "current")
        fresh, now = current.agg(F.sum(F.col("fresh").cast("int")), F.sum("sim")).first()
        current = current.drop("fresh")
        if (fresh or 0) <= delta * k * n or (now or 0.0) - total <= gain * abs(total):
            break
        total = now
    return current, turn + 1
