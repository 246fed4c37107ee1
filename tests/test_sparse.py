import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lamina.functions import text as T
from lamina.operators import sparse
from lamina.plans import catalogue

#: Documents of sf0.1 whose neighbours tie but for the last place of a logarithm.
TIES = (1705, 4879, 7727, 8081, 2820, 1206, 3294, 3079, 9703, 9630, 4659, 5617, 164, 1, 2, 3, 4, 5, 6)


def dense(vectors, width):
    out = np.zeros((len(vectors), width))
    for i, (places, values) in enumerate(vectors):
        out[i, places] = values
    return out


def vectors(n, width, seed):
    """Vectors with copies, empty ones and few different values, so that many products tie."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i % 7 == 3:
            out.append(out[int(draw.integers(i))])
        else:
            places = np.sort(draw.choice(width, int(draw.integers(0, 9 if i % 5 else 40)), replace=False))
            out.append((places, draw.integers(1, 4, len(places)) / 4))
    return out


@pytest.mark.parametrize("one_part", [sparse.ONE_PART, 20])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, one_part):
    monkeypatch.setattr(sparse, "ONE_PART", one_part)
    held = vectors(260, 100, 1)
    ids = np.random.default_rng(2).permutation(1_000)[: len(held)]
    rows = [(int(i), p.tolist(), v.tolist()) for i, (p, v) in zip(ids, held)]
    found = sparse.knn_sparse(spark.createDataFrame(rows, "id bigint, places array<bigint>, values array<double>"), 5, 100).collect()
    products = dense(held, 100) @ dense(held, 100).T  # sums of sixteenths are exact
    wanted = []
    for i, own in enumerate(ids):
        others = [x for x in np.lexsort((ids, -products[i])) if x != i][:5]
        wanted += [(int(own), r + 1, int(ids[x]), float(products[i, x])) for r, x in enumerate(others)]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_parts_meet_with_dense_places_and_known_scores():
    a, b = vectors(300, 60, 3), vectors(170, 60, 4)

    def bags(held, first):
        ends = np.concatenate(([0], np.cumsum([len(p) for p, _ in held]))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[i] for x in held]))) for i in range(2)]
        return sparse.Bags([sparse.pack(pa.table([pa.array(np.arange(first, first + len(held))), *lists], names=["id", "places", "values"]), 60)], 60)

    left, right = bags(a, 0), bags(b, 1_000)
    products = dense(a, 60) @ dense(b, 60).T
    left.known = np.sort(products, axis=1)[:, -3].copy()
    found = set(zip(*(x.tolist() for x in sparse.meet(left, right, 3, 60))))
    for line, ids, own in ((products, np.arange(1_000, 1_170), np.arange(300)), (products.T, np.arange(300), np.arange(1_000, 1_170))):
        for i, scores in enumerate(line):
            best = np.lexsort((ids, -scores))[:3]
            assert {x for x in found if x[0] == own[i]} == {(own[i], ids[j], scores[j]) for j in best if scores[j] > 0}


def test_packed_rows_are_small_and_whole():
    places = np.sort(np.random.default_rng(5).choice(16_384, (400, 300)))
    places = np.stack([np.unique(np.concatenate((x, np.arange(300))))[:300] for x in places])
    values = np.log(1 + np.random.default_rng(6).geometric(0.8, places.shape))
    ends = pa.array(np.arange(0, places.size + 1, 300).astype(np.int32))
    table = pa.table([pa.array(np.arange(400)), pa.ListArray.from_arrays(ends, pa.array(places.ravel())), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["id", "places", "values"])
    packed = sparse.pack(table, 16_384)
    held = sparse._write(packed.select(["id", "gaps", "codes", "levels"]))
    assert len(held) < 3 * places.size  # 16 bytes an entry before
    bags = sparse.Bags.of([held], 16_384)
    assert (bags.places == places.ravel()).all() and (bags.values == values.ravel()).all()


def test_unit_bags_are_those_of_the_columns(spark):
    texts = ["", None, "the AND of", "One two　two Three\x85four", "co-op\x1cerate it's x\rray", "Straße ÀB1 ab É​cole 12 345", "tab\tnew\nline\x0bfeed\x0cend " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r.id: (list(r.places), list(r["values"])) for r in T.unit_bags(df, "doc_id", "text").collect()}
    wanted = {r.id: (list(r.places), list(r["values"])) for r in T.merged_unit_bags(df, "doc_id", "text").collect()}
    assert found.keys() == wanted.keys() == set(range(len(texts)))
    for i, (places, values) in wanted.items():
        assert found[i][0] == places
        assert found[i][1] == pytest.approx(values, rel=1e-15)


def test_ties_and_repeated_ids_are_those_of_sql(spark, tmp_path, equal):
    db = duckdb.connect()
    rows = db.sql(f"select doc_id, text from '/root/testdata/sf0.1/documents.parquet' where doc_id in {TIES}").to_arrow_table()
    rows = pa.concat_tables([rows, pa.table({"doc_id": [6, 20_000, 20_001, None], "text": ["more words of another text", None, "of the", "no id"]}, schema=rows.schema)])
    pq.write_table(rows, tmp_path / "documents.parquet")
    db.register("documents", rows)
    equal(catalogue.doc_knn_bow(spark, str(tmp_path)).toPandas(), db.sql(catalogue.oracle_sql()["doc_knn_bow"]).df())
