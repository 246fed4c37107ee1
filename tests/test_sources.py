import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import knn
from lamina.sources import arrays, corpus, synthetic
from lamina.streaming import assign


def test_npy_round_trip(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "x.npy", x)
    found = arrays.read_npy(spark, str(tmp_path / "x.npy"))
    assert np.array_equal(np.stack(found.orderBy("id").toPandas()["vector"]), x)
    arrays.write_npy(found, str(tmp_path / "y.npy"), "id", "vector")
    assert np.array_equal(np.load(tmp_path / "y.npy"), x)


def test_graphs(spark, tmp_path):
    np.savez(tmp_path / "coo.npz", rows=[0, 1], cols=[1, 0], data=[0.5, 0.25], shape=[2, 2])
    np.savez(tmp_path / "csr.npz", indptr=[0, 1, 2], indices=[1, 0], data=[0.5, 0.25])
    np.savez(tmp_path / "other.npz", nothing=[1])
    for name, n in (("coo", 2), ("csr", 2), ("other", 0)):
        found = arrays.read_graph(spark, str(tmp_path / f"{name}.npz")).orderBy("i").collect()
        assert [(r["i"], r["j"], r["w"]) for r in found] == [(0, 1, 0.5), (1, 0, 0.25)][:n]


def test_idx(spark, tmp_path):
    images = struct.pack(">IIII", 2051, 2, 1, 3) + bytes([1, 2, 3, 4, 5, 255])
    labels = struct.pack(">II", 2049, 2) + bytes([7, 9])
    (tmp_path / "images.gz").write_bytes(gzip.compress(images))
    (tmp_path / "labels").write_bytes(labels)
    found = arrays.read_idx_images(spark, str(tmp_path / "images.gz")).orderBy("id").collect()
    assert [bytes(r["pixels"]) for r in found] == [b"\x01\x02\x03", b"\x04\x05\xff"]
    assert [r["label"] for r in arrays.read_idx_labels(spark, str(tmp_path / "labels")).orderBy("id").collect()] == [7, 9]
    for bad in (images[:-1], b"\0\0\0\1\0\0\0\0", b"", images[:10]):
        with pytest.raises(ValueError):
            arrays.parse_idx(bad)


def test_corpus(spark, tmp_path):
    for folder, name, body in (("b", "1", b"Hello\xff  there"), ("a", "2", b"  "), ("a", "3", b"x: y\n\nbody\n-- \nme")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(body)
    found = {r["class"]: (r["label"], r["text"]) for r in corpus.read_corpus(spark, str(tmp_path), messages=True).collect()}
    assert found == {"a": (0, "body"), "b": (1, "Hello� there")}


def test_samples(spark):
    df = spark.range(50)
    some = {r["id"] for r in corpus.sample(df, 10, 1, "id").collect()}
    assert len(some) == 10 and some == {r["id"] for r in corpus.sample(df.repartition(7), 10, 1, "id").collect()}
    assert corpus.sample(df, 120, 1, "id").count() == 120
    assert corpus.sample(df.filter("id < 0"), 5, 1, "id").count() == 0


def test_stream_of_vectors(spark, tmp_path):
    vectors, truth = synthetic.sphere_clusters(3, 20, 8, 0.05, 1)
    known = synthetic.to_table(spark, vectors)
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "id bigint, label bigint")
    known.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vec_id bigint, embedding array<double>").parquet(str(tmp_path / "in"))
    assign.assign_stream(stream, known, labels, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("id").toPandas()
    assert found["label"].tolist() == truth.tolist() and np.allclose(found["sim"], 1)


def test_kernels_agree_on_bits_and_integers(spark):
    held = synthetic.to_table(spark, synthetic.random_units(40, 8, 1))
    from lamina.functions import vectors as V

    small = held.withColumn("vector", V.quantize_int8(F.col("vector")).cast("array<double>"))
    found = knn.knn_int8(small, 5)
    a = small.select(F.col("id").alias("i"), F.col("vector").alias("a"))
    b = small.select(F.col("id").alias("j"), F.col("vector").alias("b"))
    raw = found.join(a, "i").join(b, "j").select("raw", V.int8_raw(F.col("a"), F.col("b")).alias("again"))
    assert raw.filter("raw <> again").count() == 0 and raw.count() == 200


def test_generated_tables(spark):
    n = synthetic.BLOCK + 100
    for made in (synthetic.blob_table(spark, n, 4, 7, 3, 0.1), synthetic.sphere_table(spark, n, 4, 7, 0.01, 3)):
        held = made.toPandas().sort_values("id").reset_index(drop=True)
        again = made.repartition(5).toPandas().sort_values("id")
        assert held["id"].tolist() == list(range(n)) and np.array_equal(np.stack(held["vector"]), np.stack(again["vector"]))
        vectors, truth = np.stack(held["vector"]), held["truth"].to_numpy()
        assert np.allclose(np.linalg.norm(vectors, axis=1), 1) and sorted(set(truth)) == list(range(7))
        middle = np.stack([vectors[truth == c].mean(axis=0) for c in range(7)])
        assert (np.linalg.norm(vectors - middle[truth], axis=1) < 0.3).mean() > 0.95
        assert len(np.unique(vectors, axis=0)) == n
