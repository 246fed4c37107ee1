"""Folders of texts as a labelled table, and seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text as T


def read_corpus(spark: SparkSession, path: str, messages: bool = False) -> DataFrame:
    """path, class, label, text of all files in the folders under path.

    The folder is the class, its place in alphabetical order the label. Bytes that aren't UTF-8 become
    replacement characters. messages: headers and signatures go. Texts with nothing left are dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    raw = files.select("path", F.element_at(parts, -2).alias("class"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    body = T.strip_message(F.col("text")) if messages else T.normalize_body(F.col("text"))
    rows = raw.select("path", "class", body.alias("text"))
    # one row a folder
    names = rows.select("class").distinct().agg(F.array_sort(F.collect_list("class")).alias("names"))
    labelled = rows.join(F.broadcast(names)).withColumn("label", (F.array_position("names", F.col("class")) - 1).cast("int"))
    return labelled.select("path", "class", "label", "text").filter(F.length("text") > 0)


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows by a hash of their key, without repeats; with repeats if n is above the number of rows."""
    total = df.count()
    if n <= total:
        return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
    if not total:
        return df
    # the p-th draw falls to one of total places; a row is taken as often as its place is drawn
    draws = df.sparkSession.range(n).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("_place"))
    from lamina.operators.propagate import _dense

    places = _dense(df.select(key).distinct(), key, "_place")
    return draws.join(places, "_place").drop("_place").join(df, key).select(df.columns)
