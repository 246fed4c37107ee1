"""Connected components of a link table, without bringing links to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import materialize


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over written links (u, v) with u > v.

    Each node's neighbours (large: of greater number; small: of less) are hung on the least of the
    node and its neighbours. The least is an aggregate joined back, so no node's neighbours meet in one row; it is written
    before, so that Spark broadcasts it while it is small and else may split the join at a node of very many links.
    """
    if large:
        links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        return links.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    least = materialize(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    hung = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Return node, component (the least node reachable) for every node of links (a, b).

    Alternates large and small stars until neither changes the links; the rounds grow with the
    logarithm of the longest path. Each round is written to the shared folder.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    links = materialize(links, "links")
    seen = None
    while True:
        for large in (True, False):
            links = materialize(_stars(links, large), "links")
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
