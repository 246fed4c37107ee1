"""Label propagation over edge tables, and the reduction of a graph to its parts and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import materialize

from . import graph


def vote(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One synchronous round: a vertex of label -1 takes the neighbours' label of greatest summed weight.

    The sum must be 1 or more; votes for -1 don't count; ties go to the greatest label. Sums count in
    billionths, so that the order of additions doesn't matter.
    """
    open_ = labels.filter("label < 0").select(F.col("id").alias("i"))
    cast = edges.join(open_, "i").join(labels.filter("label >= 0").select(F.col("id").alias("j"), "label"), "j")
    sums = cast.groupBy("i", "label").agg(F.round(F.sum("w"), 9).alias("votes")).filter("votes >= 1.0")
    won = sums.groupBy(F.col("i").alias("id")).agg(F.max(F.struct("votes", "label"))["label"].alias("won"))
    return labels.join(won, "id", "left").select("id", F.coalesce("won", "label").alias("label"))


def adopt(edges: DataFrame, labels: DataFrame, seed: int, rounds: int = 64) -> DataFrame:
    """Vertices still without a label take that of their strongest labelled neighbour (ties: the smaller id),
    round by round; those that none reaches take one by a hash of their id."""
    for _ in range(rounds):
        open_ = labels.filter("label < 0").select(F.col("id").alias("i"))
        near = edges.join(open_, "i").join(labels.filter("label >= 0").select(F.col("id").alias("j"), "label"), "j")
        best = near.groupBy(F.col("i").alias("id")).agg(F.max(F.struct("w", -F.col("j"), "label"))["label"].alias("found"))
        labels = materialize(labels.join(best, "id", "left").select("id", F.coalesce(F.when(F.col("label") < 0, F.col("found")), "label").alias("label"), F.col("found").isNotNull().alias("new")), "labels")
        left = labels.agg(F.sum((F.col("label") < 0).cast("int")).alias("open"), F.max("new").alias("new")).first()
        labels = labels.drop("new")
        if not left["open"] or not left["new"]:
            break
    top = labels.agg(F.greatest(F.max("label"), F.lit(0)).alias("top"))  # one row
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("top") + 1)
    return labels.join(F.broadcast(top)).select("id", F.when(F.col("label") < 0, drawn).otherwise(F.col("label")).alias("label"))


def contiguous(labels: DataFrame) -> DataFrame:
    """Labels as 0, 1, ... in their order; every -1 becomes a label of its own, in order of ids."""
    kinds = labels.filter("label >= 0").select("label").distinct()
    numbered = _dense(kinds, "label", "new")
    alone = _dense(labels.filter("label < 0").select("id"), "id", "extra")
    count = numbered.agg(F.count("*").alias("kinds"))  # one row
    known = labels.filter("label >= 0").join(numbered, "label").select("id", F.col("new").alias("label"))
    return known.unionByName(alone.join(F.broadcast(count)).select("id", (F.col("kinds") + F.col("extra")).alias("label")))


def _dense(keys: DataFrame, key: str, out: str) -> DataFrame:
    """0, 1, ... for distinct keys in order: ranges are numbered apart and then shifted by what lies before."""
    parts = keys.repartitionByRange(key).withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    starts = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(key)
    return parts.join(F.broadcast(starts), "part").select(key, (F.col("start") + F.row_number().over(inside) - 1).alias(out))


def partition(edges: DataFrame, ids: DataFrame, parts: int, rounds: int = 20, seed: int = 42) -> DataFrame:
    """id, label: about so many parts of a graph, numbered from 0 without gaps.

    Seeds are the parts vertices of least hash; rounds of voting follow, then adoption of the rest.
    """
    ids = ids.select("id")
    first = Window.orderBy("h", "id")
    seeds = ids.withColumn("h", F.xxhash64(F.lit(seed), "id")).orderBy("h", "id").limit(parts)
    seeds = seeds.withColumn("label", (F.row_number().over(first) - 1).cast("bigint")).select("id", "label")
    labels = materialize(ids.join(seeds, "id", "left").select("id", F.coalesce("label", F.lit(-1).cast("bigint")).alias("label")), "labels")
    for _ in range(rounds):
        labels = materialize(vote(edges, labels), "labels")
        if not labels.filter("label < 0").limit(1).count():
            break
    return contiguous(adopt(edges, labels, seed))


def part_means(rows: DataFrame, parts: DataFrame, vector: str = "vector") -> DataFrame:
    """id (of the part), x: mean vector of each part."""
    placed = rows.join(parts, "id").select(F.col("label").alias("id"), F.posexplode(vector).alias("pos", "value"))
    return graph.as_vectors(placed.groupBy("id", "pos").agg(F.avg("value").alias("value")))


def reduce_graph(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Weights between parts p and q: their sum over the root of the size of p, clipped to 0 and 1."""
    sizes = parts.groupBy(F.col("label").alias("i")).agg(F.count("*").alias("n"))
    a, b = parts.select(F.col("id").alias("i"), F.col("label").alias("p")), parts.select(F.col("id").alias("j"), F.col("label").alias("q"))
    sums = edges.join(a, "i").join(b, "j").groupBy(F.col("p").alias("i"), F.col("q").alias("j")).agg(F.sum("w").alias("s"))
    weight = F.least(F.greatest(F.col("s") / F.sqrt("n"), F.lit(0.0)), F.lit(1.0))
    return sums.join(sizes, "i").select("i", "j", weight.alias("w")).filter("w <> 0")


def expand(edges: DataFrame, parts: DataFrame, layout: DataFrame) -> DataFrame:
    """id, x: half the own part's place, half the neighbours' parts' places weighted by mutual strength
    over the root of the part's size. Without mutual neighbours that half is 0."""
    sizes = parts.groupBy("label").agg(F.count("*").alias("n"))
    scaled = parts.join(sizes, "label").select(F.col("id").alias("i"), F.col("label").alias("j"), (1 / F.sqrt("n")).alias("w"))
    toward = graph.l1_rows(graph.matmul(graph.hadamard(edges), scaled))
    near = graph.matmul_dense(toward, layout).withColumnRenamed("x", "near")
    own = parts.join(layout.withColumnRenamed("id", "label"), "label").select("id", "x")
    mixed = F.transform(F.arrays_zip("x", "near"), lambda s: (s["x"] + F.coalesce(s["near"], F.lit(0.0))) * 0.5)
    alone = F.transform("x", lambda x: x * 0.5)
    return own.join(near, "id", "left").select("id", F.when(F.col("near").isNull(), alone).otherwise(mixed).alias("x"))


def jitter(layout: DataFrame, parts: DataFrame, scale: float, seed: int) -> DataFrame:
    """Each vertex at its part's place plus normal noise drawn by a hash of its id."""
    own = parts.join(layout.withColumnRenamed("id", "label"), "label")
    return own.select("id", F.transform("x", lambda x, i: x + scale * normal(F.lit(seed), F.col("id"), i)).alias("x"))


def uniform(*keys) -> Column:
    """A number in (0, 1) by a hash of the keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(2**52)).cast("double") + 0.5) / F.lit(float(2**52))


def normal(*keys) -> Column:
    """A standard normal number by hashes of the keys."""
    return F.sqrt(-2 * F.log(uniform(*keys, F.lit(1)))) * F.cos(2 * 3.141592653589793 * uniform(*keys, F.lit(2)))


def centred(layout: DataFrame, scaling: float = 0.5) -> DataFrame:
    """Scaled and moved so that every component has mean 0."""
    long = layout.select("id", F.posexplode("x").alias("pos", "value"))
    means = long.groupBy("pos").agg(F.avg("value").alias("mean"))  # one row a component
    return graph.as_vectors(long.join(F.broadcast(means), "pos").select("id", "pos", (scaling * (F.col("value") - F.col("mean"))).alias("value")))
