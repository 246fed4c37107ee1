"""Streams of new vectors assigned to the clusters of a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.operators import blocks, knn


def assign(rows: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label, sim: for each new row (id, vector, dim) the label of its nearest known row. Ids of new
    rows may repeat known ones."""
    shifted = known.withColumn("id", -F.col("id") - 1)  # keeps the two kinds of ids apart
    found = blocks.search(shifted, rows, knn.inner_product_kernel(1), 1, "double")
    named = labels.select((-F.col("id") - 1).alias("vec_id"), "label")
    return found.join(named, "vec_id").select(F.col("query_id").alias("id"), "label", F.col("score").alias("sim"))


def assign_stream(stream: DataFrame, known: DataFrame, labels: DataFrame, path: str, checkpoint: str, vec_id: str = "vec_id", vector: str = "embedding") -> StreamingQuery:
    """Write what assign returns for each micro-batch under path. A batch that runs again replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        rows = blocks.valid_vectors(batch, vec_id, vector)
        assign(rows, known, labels).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
