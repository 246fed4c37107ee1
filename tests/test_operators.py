import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.functions import vectors as V
from lamina.operators import descent, embed, graph, initial, knn, layers, propagate, spanning
from lamina.plans import estimator
from lamina.session import materialize
from lamina.sources import synthetic


def agreement(label, truth):
    """Share of pairs of labelled points that both clusterings treat alike."""
    some = np.flatnonzero(label >= 0)
    a, b = label[some], truth[some]
    return ((a[:, None] == a[None, :]) == (b[:, None] == b[None, :])).mean()


def test_empty_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (6, [0.0, 0.0])]
    held = knn.vector_table(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert {(r["id"], tuple(r["vector"])) for r in held.collect()} == {(1, (1.0, 0.0)), (6, (0.0, 0.0))}
    found = knn.knn_cosine(held, 15).orderBy("i", "rank").collect()
    assert [(r["i"], r["j"], r["dist"]) for r in found] == [(1, 1, 0.0), (1, 6, 0.0), (6, 6, 0.0), (6, 1, 0.0)]
    assert knn.knn_cosine(held.filter("id < 0"), 3).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    held = synthetic.to_table(spark, np.tile([[0.6, 0.8]], (6, 1)))
    found = knn.knn_cosine(held, 3).filter("i = 4").orderBy("rank").collect()
    assert [r["j"] for r in found] == [4, 0, 1]
    assert knn.duplicates(knn.knn_cosine(held, 6)).count() == 15


def test_blocks_are_seamless(spark):
    held = synthetic.to_table(spark, synthetic.random_units(300, 6, 3))
    whole = knn.blocks.search(held, held, knn.inner_product_kernel(4), 4, "double").collect()
    cut = knn.blocks.search(held, held, knn.inner_product_kernel(4), 4, "double", shard_rows=37, block_rows=50).collect()
    assert set(whole) == set(cut) and len(whole) == 1200


@pytest.mark.parametrize("samples", [1, 4])
def test_rounds_grow_the_same_tree(spark, samples):
    held = synthetic.to_table(spark, synthetic.random_units(60, 3, 5))
    one = spanning.spanning_tree(held, samples).toPandas().sort_values(["a", "b"])
    many = spanning.spanning_tree(held, samples, on_one=0).toPandas().sort_values(["a", "b"])
    assert np.allclose(sorted(one["w"]), sorted(many["w"]))
    if samples == 1:
        assert one[["a", "b"]].to_numpy().tolist() == many[["a", "b"]].to_numpy().tolist()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in layers.spanning.components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_components_of_a_tree_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(spanning, "components", None)
    tree = spark.createDataFrame([(1, 2, 0.5), (2, 5, 1.0), (3, 5, 1.5), (3, 4, 0.25)], "a bigint, b bigint, w double")
    found = spanning.components_at(tree, spark.range(1, 7), 1.0)
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (5, 1), (3, 3), (4, 3), (6, 6)}


def test_labels_reach_everyone(spark):
    edges = spark.createDataFrame([(a, a + 1, 0.5) for a in range(9)] + [(a + 1, a, 0.5) for a in range(9)], "i bigint, j bigint, w double")
    labels = spark.createDataFrame([(0, 3)] + [(i, -1) for i in range(1, 12)], "id bigint, label bigint")
    assert propagate.vote(edges, labels).filter("label >= 0").count() == 1  # a vote of 0.5 is not enough
    found = {r["id"]: r["label"] for r in propagate.adopt(edges, labels, 1).collect()}
    assert [found[i] for i in range(10)] == [3] * 10 and all(0 <= found[i] <= 3 for i in (10, 11))


def test_array_and_table_forms_agree(spark):
    vectors, _ = synthetic.sphere_clusters(3, 30, 8, 0.2, 1)
    held = synthetic.to_table(spark, vectors)
    edges = materialize(graph.fuzzy_union(graph.directed(knn.knn_cosine(held, 6), 6)), "edges")
    e = edges.toPandas().sort_values(["i", "j"])
    i, j, w = e["i"].to_numpy(), e["j"].to_numpy(), e["w"].to_numpy()
    label = np.where(np.arange(90) < 12, np.arange(90), -1)
    table = propagate.vote(edges, spark.createDataFrame([(n, int(v)) for n, v in enumerate(label)], "id bigint, label bigint"))
    assert table.orderBy("id").toPandas()["label"].tolist() == initial.vote_arrays(i, j, w, label).tolist()
    part = np.arange(90) % 7
    parts = spark.createDataFrame([(n, int(v)) for n, v in enumerate(part)], "id bigint, label bigint")
    a, b, v = initial.reduce_arrays(i, j, w, part, 7)
    below = {(r["i"], r["j"]): r["w"] for r in propagate.reduce_graph(edges, parts).collect()}
    assert below == pytest.approx({(p, q): x for p, q, x in zip(a.tolist(), b.tolist(), v.tolist())})
    places = np.random.RandomState(0).normal(size=(7, 3))
    expanded = propagate.expand(edges, parts, synthetic.to_table(spark, places).select("id", F.col("vector").alias("x")))
    assert np.allclose(np.stack(expanded.orderBy("id").toPandas()["x"]), initial.expand_arrays(i, j, w, part, places))


def test_layout_pulls_neighbours_together(spark):
    vectors, _ = synthetic.sphere_clusters(4, 40, 16, 0.1, 2)
    held = synthetic.to_table(spark, vectors)
    edges = materialize(graph.fuzzy_union(graph.directed(knn.knn_cosine(held, 8), 8)), "edges")
    start = embed.random_layout(held, 4, 7)
    found = np.stack(embed.node_layout(edges, start, 30, seed=1).orderBy("id").toPandas()["x"])
    again = np.stack(embed.node_layout(edges, start, 30, seed=1).orderBy("id").toPandas()["x"])
    assert np.isfinite(found).all() and np.array_equal(found, again)
    e = edges.toPandas()
    along = np.linalg.norm(found[e["i"]] - found[e["j"]], axis=1).mean()
    apart = np.linalg.norm(found[:, None] - found[None], axis=2).mean()
    assert along < 0.5 * apart


def test_layout_as_jobs(spark):
    vectors, _ = synthetic.sphere_clusters(2, 15, 8, 0.1, 2)
    held = synthetic.to_table(spark, vectors)
    edges = materialize(graph.fuzzy_union(graph.directed(knn.knn_cosine(held, 5), 5)), "edges")
    found = embed.node_layout(edges, embed.random_layout(held, 3, 7), 4, on_one=0)
    assert found.count() == 30 and found.filter(F.exists("x", lambda x: F.isnan(x) | x.isNull())).count() == 0


def purity(label, truth):
    some = np.flatnonzero(label >= 0)
    return sum(np.bincount(truth[some][label[some] == c]).max() for c in set(label[some])) / len(some)


def test_clusters_are_recovered(spark):
    """Ten blobs of twenty points each are ten clusters, give or take."""
    vectors, truth = synthetic.blobs(200, 32, 10, 42)
    found = estimator.fit(synthetic.to_table(spark, vectors))
    label = found.layers.filter("layer = 0").orderBy("id").toPandas()["label"].to_numpy()
    assert 8 <= len(set(label) - {-1}) <= 14 and (label >= 0).mean() > 0.8
    assert purity(label, truth) > 0.95 and agreement(label, truth) > 0.95
    assert found.cluster_tree().count() >= 1 and found.duplicates().count() == 0


def test_wanted_number_of_clusters(spark):
    vectors, truth = synthetic.sphere_clusters(4, 100, 32, 0.06, 42)
    wanted = estimator.fit(synthetic.to_table(spark, vectors), estimator.Params(approx_n_clusters=4)).labels().orderBy("id").toPandas()
    assert len(set(wanted["label"]) - {-1}) == 4 and agreement(wanted["label"].to_numpy(), truth) > 0.95


def test_tables_path_recovers_clusters(spark):
    vectors, truth = synthetic.sphere_clusters(3, 40, 16, 0.08, 42)
    held = synthetic.to_table(spark, vectors)
    edges = materialize(graph.fuzzy_union(graph.directed(knn.knn_cosine(held, 10), 10)), "edges")
    start = materialize(initial.initial_layout(edges, held, 4, 24, rounds=3, epochs=10), "start")
    assert start.count() == 120
    x = np.stack(start.orderBy("id").toPandas()["x"])
    inside = np.mean([np.linalg.norm(x[truth == c][:, None] - x[truth == c][None], axis=2).mean() for c in range(3)])
    assert inside < np.linalg.norm(x[:, None] - x[None], axis=2).mean()


def test_other_metrics_fit(spark):
    vectors, _ = synthetic.sphere_clusters(3, 40, 32, 0.08, 1)
    held = synthetic.to_table(spark, vectors)
    small = held.withColumn("vector", V.quantize_int8(F.col("vector")).cast("array<double>"))
    bits = held.withColumn("vector", V.pack_signs(F.col("vector"), 32).cast("array<double>")).withColumn("dim", F.lit(1))
    for rows, metric in ((small, "int8"), (bits, "bits")):
        found = estimator.fit(rows, estimator.Params(metric=metric, init=None, n_epochs=10))
        assert found.layers.filter("layer = 0").count() == 120


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_rows_fit(spark, n):
    found = estimator.fit(synthetic.to_table(spark, synthetic.random_units(n, 4, 1)))
    assert found.labels().count() == n


def test_base_layouts():
    vectors, _ = synthetic.sphere_clusters(3, 10, 8, 0.1, 1)
    for how in ("pca", "mds", "spectral", "random"):
        x = initial.base_layout(vectors, 30, 4, 1, how)
        assert x.shape == (30, 4) and np.isfinite(x).all()


def test_descent_finds_neighbours(spark):
    vectors, _ = synthetic.sphere_clusters(4, 60, 16, 0.3, 3)
    held = synthetic.to_table(spark, vectors)
    leaves = descent.forest(held, leaf_size=20, trees=2)
    assert leaves.groupBy("tree").count().filter("count = 240").count() == 2
    assert leaves.groupBy("tree", "leaf").count().agg(F.max("count")).first()[0] <= 20
    found = descent.neighbor_descent(held, 8, trees=2, rounds=3)
    true = knn.knn_cosine(held, 9).filter("i <> j").select("i", "j")
    assert found.join(true, ["i", "j"]).count() / true.count() > 0.95


@pytest.mark.parametrize("metric", ["int8", "bits"])
def test_approximate_tables_of_other_metrics(spark, metric):
    vectors, _ = synthetic.sphere_clusters(3, 50, 64, 0.3, 5)
    held = synthetic.to_table(spark, vectors)
    held = held.withColumn("vector", V.quantize_int8(F.col("vector")) if metric == "int8" else V.pack_signs(F.col("vector"), 64))
    held = materialize(held.withColumn("dim", F.size("vector")), "held")
    exact, near = knn.TABLES[metric][0](held, 8), knn.knn_approximate(held, 8, metric, trees=3, leaf_size=20)
    assert near.columns == exact.columns
    whole = exact.toPandas().merge(near.toPandas(), on=["i", "j"], suffixes=("", "_near"))
    assert len(whole) > 0.9 * exact.count() and np.allclose(whole["dist"], whole["dist_near"])


def test_trees_as_jobs_search_few_rows(spark, monkeypatch):
    """Most edges come from one search of lists; copies and ties of mutual reachability give the tree of one task."""
    x = synthetic.random_units(70, 8, 3)
    x = np.concatenate([x, x[:10], np.repeat(x[:1], 6, axis=0)])
    core = np.sort(np.stack([spanning.distances(np.ascontiguousarray(x.T), p) for p in x]), axis=1)[:, 5]
    wanted = sorted((min(a, b), max(a, b), w) for a, b, w in spanning.prim(np.arange(len(x)), x, core).tolist())
    asked, search = [], spanning.nearest_outside
    monkeypatch.setattr(spanning, "nearest_outside", lambda rows, some: asked.append(some.count()) or search(rows, some))
    found = spanning.spanning_tree(materialize(synthetic.to_table(spark, x), "held"), 5, on_one=0)
    assert sorted(map(tuple, found.collect())) == wanted
    assert sum(asked) < len(x)


def test_a_tree_searches_all_rows_once(spark, monkeypatch):
    """One search gives lists and core distances; rounds over arrays and rounds as jobs give the tree of one task."""
    x = synthetic.random_units(60, 4, 5)
    x = np.concatenate([x, x[:20], np.repeat(x[:1], 20, axis=0), np.round(x * 2)])
    core = np.sort(np.stack([spanning.distances(np.ascontiguousarray(x.T), p) for p in x]), axis=1)[:, 3]
    wanted = sorted((min(a, b), max(a, b), w) for a, b, w in spanning.prim(np.arange(len(x)), x, core).tolist())
    held = materialize(synthetic.to_table(spark, x), "held")
    whole, search = [], knn.blocks.search
    monkeypatch.setattr(knn.blocks, "search", lambda rows, some, *a, **b: whole.append(some is rows) or search(rows, some, *a, **b))
    assert sorted(map(tuple, spanning.spanning_tree(held, 3, on_one=0).collect())) == wanted
    assert sum(whole) == 1
    assert sorted(map(tuple, spanning.boruvka(held, 3, arrays=0).collect())) == wanted


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_single_precision_rules_no_neighbour_out(shift):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(900, 5)), rng.integers(0, 3, (900, 5)), rng.normal(size=(300, 5)) * 1e-6]) + shift
    ids, k = rng.permutation(len(x)), 3
    found = knn.euclidean_kernel(k)(ids, x, ids[::7], x[::7])
    at = 0
    for own, query in zip(ids[::7], x[::7]):
        far = sum((query[d] - x[:, d]) ** 2 for d in range(5))
        some = np.flatnonzero(ids != own)
        some = some[np.lexsort((ids[some], far[some]))[:k]]
        assert [f[at : at + k].tolist() for f in found] == [[own] * k, ids[some].tolist(), (-far[some]).tolist()]
        at += k
    assert at == len(found[0])


@pytest.mark.parametrize("metric", ["cosine", "bits"])
def test_descent_finds_neighbours_without_structure(spark, metric):
    """In noise lists of k alone end far from the neighbours."""
    held = synthetic.to_table(spark, synthetic.random_units(800, 64, 3))
    if metric == "bits":
        held = held.withColumn("vector", V.pack_signs(F.col("vector"), 64))
    held = materialize(held.withColumn("dim", F.size("vector")), "held")
    near = materialize(knn.knn_approximate(held, 5, metric, trees=1, leaf_size=10), "near")
    true = knn.TABLES[metric][0](held, 5)
    assert near.count() == 800 * 5
    assert near.join(true.select("i", "j"), ["i", "j"]).count() / true.count() >= 0.9


def test_fit_by_descent(spark):
    vectors, truth = synthetic.sphere_clusters(4, 60, 16, 0.1, 3)
    params = estimator.Params(brute_force_limit=100, n_trees=3, leaf_size=20, n_descent_rounds=3, delta=0.01)
    found = estimator.fit(synthetic.to_table(spark, vectors), params)
    label = found.labels().orderBy("id").toPandas()["label"].to_numpy()
    for one in set(label.tolist()) - {-1}:  # no label covers two of the clusters
        assert np.bincount(truth[label == one]).max() > 0.9 * (label == one).sum()
    assert found.knn.columns == knn.knn_cosine(synthetic.to_table(spark, vectors), 15).columns


def test_equal_vectors_split(spark):
    leaves = descent.forest(synthetic.to_table(spark, np.ones((50, 3))), leaf_size=10, trees=1)
    assert leaves.count() == 50 and leaves.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 10


def test_texts(spark):
    rows = [(1, "Head: x\r\n\r\nThe Body  of\tit\n-- \nname\n"), (2, ""), (3, None), (4, "It's a TEST, test　test"), (5, "a\n--\nb\n--\nc")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r["doc_id"]: r["t"] for r in df.select("doc_id", T.strip_message(F.col("text")).alias("t")).collect()}
    assert found == {1: "The Body of it", 2: "", 3: None, 4: "It's a TEST, test　test".replace("　", " "), 5: "a -- b"}
    tokens = sorted((r["doc_id"], r["token"]) for r in T.tokens(df, "doc_id", "text").collect())
    assert (4, "test") in tokens and (4, "its") not in tokens and (1, "the") not in tokens and (1, "body") in tokens


BARS = [(5.0, 40.0, 0.0, True), (9.0, 12.0, 0.3, False), (5.0, 12.0, 0.3, False), (5.0, 9.0, 0.5, False), (5.0, 9.0, 0.5, False), (7.0, 20.0, 0.1, False), (8.0, 8.0, 0.9, False)]


def test_persistence_of_given_bars(spark):
    from lamina.operators import report

    bars = spark.createDataFrame(BARS, "birth double, death double, fade double, root boolean")
    found = {r["size"]: r["total"] for r in report.total_persistence(bars).collect()}
    sizes = sorted({b for b, *_ in BARS})
    assert found.keys() == set(sizes)
    for size in sizes:
        assert found[size] == pytest.approx(sum((d - b) * f for b, d, f, root in BARS if not root and b <= size < d))
    assert report.active_similarity(bars, 5, 10).first()["jaccard"] == pytest.approx(2 / 6)
    assert report.active_similarity(bars.limit(0), 5, 10).first()["jaccard"] == 0
