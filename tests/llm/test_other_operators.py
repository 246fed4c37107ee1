import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import ann, exact_topk, queries, sharding, source_mix, url_filter

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf_dir, equal, name):
    equal(queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


# URLs ---------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "example.com/en/", "http://example.com", "http://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.b.www.example.com/en/1?x#y", "http://net/es/",
    "http://x.net/es", "http://x.net/fr/?q", "http://xnet/fr/", "http://com/", "http://.com/", "http://a.com?/en/", "http://a.com#/", "http://ÄB.com/é", "://com/x", "http://u://example.com/en/",
    "http://example.com/EN/", "http://example.com./en/", "http://" + "a." * 500 + "net/fr/" + "x" * 5000, "http://example.com/en/\n?", "http://x.net/fr/",
]


def test_urls_equal_brute_force(spark):
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(URLS)] + [(3, URLS[3], "", "", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string, digest string")
    found = sorted(map(tuple, url_filter.url_filter(df).collect()))
    assert found == sorted((i, *brute.url(u, url_filter.RULES)) for i, u, *_ in rows)
    assert url_filter.url_filter(df.filter("page_id < 0")).count() == 0
    assert url_filter.url_filter(df, []).filter("verdict = 'allow' and rule is null").count() == len(rows)


def test_letters_beyond_a_to_z_and_odd_columns(spark):
    rows = [(1, "http://ÄB.Com/x"), (2, "http://äb.com/x"), (None, None), (3, "http://a.ÄB.com/xy?q"), (4, "no url"), (4, "no url"), (5, "http://" + "a." * 3000 + "com/" + "p" * 5000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("a.b", F.lit(1)).withColumn("host", F.lit("clash")).withColumn("rule", F.lit(2))
    found = url_filter.url_filter(df, [("block", "ÄB.COM", "/x"), ("block", "com", "/ppp")])
    assert sorted((r["page_id"] or 0, r["rule"]) for r in found.collect() if r["rule"]) == [(1, "Äb.com/x"), (3, "Äb.com/x"), (5, "com/ppp")]
    assert found.count() == 7 and url_filter.url_filter(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_filter.url_filter(df, [("block", f"h{i}", "/") for i in range(url_filter.MAX_RULES + 1)])


def test_a_url_of_most_pages(spark):
    df = spark.range(20_000).selectExpr("id as page_id", "case when id % 10 < 9 then 'http://www.example.com/en/a' else concat('http://h', id, '.net/fr/') end as url")
    found = url_filter.url_filter(df).groupBy("rule", "verdict").count().collect()
    assert sorted(map(tuple, found)) == [("net/fr/", "block", 2_000), ("www.example.com/en/", "allow", 18_000)]


def test_many_rules(spark):
    rng = random.Random(1)
    rules = [(rng.choice(["allow", "block"]), ".".join(rng.choices(["a", "b", "c"], k=rng.randrange(1, 4))), "/" + "".join(rng.choices("xy/", k=rng.randrange(0, 4)))) for _ in range(60)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = ["http://" + ".".join(rng.choices(["a", "b", "c"], k=rng.randrange(1, 5))) + "/" + "".join(rng.choices("xy/?", k=5)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(df, rules).collect()}
    for i, u in enumerate(urls):
        rule, verdict = brute.url(u, rules)[2:]
        assert (rule and len(rule), verdict if rule else "allow") == (found[i][0] and len(found[i][0]), found[i][1])
    with pytest.raises(ValueError):
        url_filter.url_filter(df, [("block", "a", "/" * 3000)])


# Sharding -----------------------------------------------------------------------------------------------------


def check_shards(rows, shards):
    assert {r["law"] for r in rows} <= {"bytes"} and {r["grown_shard"] for r in rows} <= {None}
    by_text, by_shard = {}, {}
    for r in rows:
        by_text.setdefault(r["text"], set()).add(r["shard"])
        by_shard.setdefault(r["shard"], []).append(r)
    assert all(len(s) == 1 for s in by_text.values()) and all(0 <= s < shards for s in by_shard)
    for held in by_shard.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    return max((sum(r["size"] for r in held) for held in by_shard.values()), default=0)


@pytest.mark.parametrize("shards,known", [(24, 50_000), (3, 50_000), (5, 1), (1, 3)])
def test_shards_are_minimax(spark, monkeypatch, shards, known):
    import hashlib

    monkeypatch.setattr(sharding, "MAX_KNOWN", known)
    monkeypatch.setattr(sharding, "BUCKETS", 4)
    rng = random.Random(shards)
    texts = ["x" * rng.randrange(0, 60) + rng.choice("abé") for _ in range(60)] + ["hot"] * 40 + [None, "", "", "é" * 300]
    docs = [(i % 90, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("size", F.lit("clash")).withColumn("shard", F.lit(1))
    found = sharding.shard_documents(df, shards)
    sizes = {}
    for _, t in docs:
        key = "" if t is None else hashlib.sha256(t.encode()).hexdigest()
        sizes[key] = sizes.get(key, 0) + len((t or "").encode()) + 8
    held = df.select(F.crc32(F.col("text").cast("binary")).alias("c"), "text").distinct()
    rows = found.join(held, F.col("text_crc32").eqNullSafe(F.col("c"))).collect()
    assert len(rows) == len(docs)
    assert check_shards(rows, shards) == brute.minimax([sizes[k] for k in sorted(sizes)], shards)


def test_no_documents_to_shard(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.shard_documents(df).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(df, 0)


def test_search_over_boundaries_narrows(monkeypatch):
    """The bracket closes on the answer from few known boundaries."""
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 80))]
        ends = np.cumsum(sizes).tolist()
        points = [(e, i + 1) for i, e in enumerate(ends)]
        known = points[:: rng.randrange(1, 20)] + points[-1:]
        shards, low = rng.randrange(1, 8), max(sizes)
        while True:
            bounds = sharding.Boundaries(known)
            low = bounds.smallest(low, shards, True)
            high = bounds.smallest(low, shards, False)
            gaps = bounds.open_gaps(low, high, shards)
            if not gaps:
                break
            known += [p for p in points if any(a < p[0] <= b for a, b in gaps)]
        assert high == brute.minimax(sizes, shards)


# Mixing -------------------------------------------------------------------------------------------------------


def test_mixture_meets_its_targets(spark):
    rows = [(i, f"t{i}", "a" if i % 10 else "b") for i in range(6000)] + [(9000 + i, "u", None) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copy", F.lit("clash"))
    found = source_mix.mix_sources(df, {"a": 0.25, "b": 0.75, "none": 3.0}, total=8000)
    counts = Counter(r["source"] for r in found.collect())
    for source, wanted in (("a", 2000), ("b", 6000), (None, 500)):
        assert abs(counts[source] - wanted) < 5 * math.sqrt(wanted)
    again = source_mix.mix_sources(df.repartition(3), {"a": 0.25, "b": 0.75, "none": 3.0}, total=8000)
    assert sorted(found.select("doc_id", "copy").collect()) == sorted(again.select("doc_id", "copy").collect())
    copies = [r["copy"] for r in found.filter("doc_id = 10").collect()]
    assert sorted(copies) == list(range(1, len(copies) + 1))


@pytest.mark.parametrize("total", [1_000, 1_000_000])
def test_a_rare_source_is_drawn_in_parts(spark, total):
    """One row stands for nearly the whole mixture: its copies are counted and dealt like those of many rows."""
    rows = [(i, "t", "a") for i in range(100)] + [(500, "rare", "b"), (501, "rare", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = source_mix.mix_sources(df, {"a": 0.01, "b": 0.99}, total=total)
    got = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("d")).collect()
    assert all(r["n"] == r["d"] for r in got)
    of = {r["doc_id"]: r["n"] for r in got}
    for doc in (500, 501):
        assert abs(of[doc] - 0.495 * total) < 5 * math.sqrt(0.495 * total)
    assert of[500] != of[501]
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert total < 10_000 or max(sizes) < 0.6 * total  # few rows end up in one task


def test_columns_of_a_mixture(spark):
    df = spark.createDataFrame([(i, "t" * i, "a") for i in range(50)], "doc_id bigint, text string, source string")
    odd = df.withColumn("a.b", F.lit(1)).withColumn("mix_key", F.lit(2)).withColumn("Copy", F.lit(3)).withColumn("steps", F.lit(4))
    found = source_mix.mix_sources(odd, {"a": 1.0}, names=("r", "c", "k"))
    assert found.columns == [*odd.columns, "r", "c", "k"]
    assert found.select("`a.b`", "mix_key", "Copy", "steps").distinct().collect() == [(1, 2, 3, 4)]
    assert sorted(found.select("doc_id", "c").collect()) == sorted(source_mix.mix_sources(df, {"a": 1.0}).select("doc_id", "copy").collect())


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert source_mix.mix_sources(df).count() == 0
    one = spark.createDataFrame([(None, "t", "a"), (1, None, "z")], "doc_id bigint, text string, source string")
    assert source_mix.mix_sources(one, {}).count() >= 0 and source_mix.mix_sources(one, {"a": 0.0}).filter("source = 'a'").count() == 0
    with pytest.raises(ValueError):
        source_mix.mix_sources(one, {"a": -1.0})


@pytest.mark.parametrize("rate", [0.05, 1.0, 7.5, 900.0])
def test_poisson_steps(rate):
    steps = source_mix.poisson_cdf(rate)
    assert abs(steps[-1] - 1) < 1e-9 and steps == sorted(steps)
    mean = sum(k * (b - a) for k, (a, b) in enumerate(zip([0, *steps], steps)))
    assert mean == pytest.approx(rate, rel=1e-6)


# Vectors ------------------------------------------------------------------------------------------------------


def vector_rows(seed=0, n=400, d=16):
    x = np.random.RandomState(seed).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:210] = x[200]
    rows = [(i, v.astype(np.float32).tolist(), "s", 1.0) for i, v in enumerate(x)]
    odd = [(1000, None), (1050, [None] * d), (1100, [float("nan")] * d), (1150, [float("inf")] * d), (1200, []), (None, x[0].tolist()), (1250, [0.0] * d), (1300, [1.0, 2.0])]
    return rows + [(i, v, "s", 1.0) for i, v in odd] + [rows[5], rows[50]]


VECTORS = "vec_id bigint, embedding array<float>, rank string, score double"


def brute_search(rows, every, k, score, usable):
    held = {}
    for i, v, *_ in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and usable(v):
            held.setdefault(i, [float(c) for c in v])
    out = []
    for q in sorted(i for i in held if i % every == 0):
        best = sorted((-score(held[q], v), i) for i, v in held.items() if i != q and len(v) == len(held[q]))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, start=1)]
    return out


@pytest.mark.parametrize("levels,shard", [(24, 8192), (3, 70)])
def test_exact_topk_equals_brute_force(spark, monkeypatch, levels, shard):
    monkeypatch.setattr(exact_topk.vectors.search, "__defaults__", (shard, 3))
    rows = vector_rows()
    found = sorted(map(tuple, exact_topk.exact_topk(spark.createDataFrame(rows, VECTORS), levels=levels).collect()))

    def score(a, b):
        return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))

    assert found == brute_search(rows, 50, 5, score, lambda v: True)
    assert exact_topk.exact_topk(spark.createDataFrame([], VECTORS)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0], "", 0.0), (1, [1.0, 1.0], "", 0.0)], VECTORS)
    assert [tuple(r) for r in exact_topk.exact_topk(few).collect()] == [(0, 1, 1, 256 * 256 * 3)]


@pytest.mark.parametrize("size", [4095.0, 4097.0, 5000.0, 1e6])
def test_components_of_any_size(spark, size):
    """On both sides of what fits a packed sum, down to the last bit."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * (size if i % 7 == 0 else 1.0)).tolist()) for i in range(120)]
    found = exact_topk.exact_topk(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), every=10).collect()
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for query in range(0, 120, 10):
        scores = sorted(((-sum(a * b for a, b in zip(whole[query], v)), i) for i, v in whole.items() if i != query))[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query] == [(i, -s) for s, i in scores]


def test_a_score_beyond_64_bits_fails(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, -1.0]), (2, [0.5, 0.5])]
    with pytest.raises(Exception, match="beyond 64 bits"):
        exact_topk.exact_topk(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()


def test_search_stops_on_proof():
    """On vectors with clear neighbours only a part of the postings is processed, and nothing is lost."""
    rng = np.random.RandomState(1)
    rows = np.floor(64 * rng.normal(size=(3000, 24)) / 5).astype(np.int64)
    rows[::100] = 4 * rows[0]
    index = exact_topk.ImpactIndex(np.arange(3000), rows)
    ids, scores = index.top(0, rows[0], 5)
    exact = rows @ rows[0]
    wanted = [i for i in np.lexsort((np.arange(3000), -exact)) if i][:5]
    assert ids.tolist() == wanted and scores.tolist() == exact[wanted].tolist()


def test_nearest_neighbours(spark):
    rows = vector_rows(3)
    found = sorted(map(tuple, ann.nearest(spark.createDataFrame(rows, VECTORS)).collect()))

    def score(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    wanted = brute_search(rows, 20, 20, score, any)
    scores = {(q, i): s for q, _, i, s in brute_search(rows, 20, 10**6, score, any)}
    assert all(scores[q, i] == s for q, _, i, s in found)
    ranks = Counter(q for q, *_ in found)
    assert ranks == Counter(q for q, *_ in wanted)
    assert len({(q, i) for q, _, i, _ in found} & {(q, i) for q, _, i, _ in wanted}) / len(wanted) >= 0.9
    by_query = {}
    for q, n, i, s in found:
        by_query.setdefault(q, []).append((n, -s, i))
    assert all([n for n, *_ in v] == list(range(1, len(v) + 1)) and [x[1:] for x in v] == sorted(x[1:] for x in v) for v in by_query.values())
    assert ann.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_on_the_table(spark, sf_dir):
    found = queries.op8_ann(spark, sf_dir).toPandas()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    hits = 0
    for q, held in found.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(held["vec_id"]))
    assert hits / len(found) >= 0.9


@pytest.mark.parametrize("spread", [0, 0.3, 1])
def test_recall_on_a_full_shard(spread):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((ann.vectors.SHARD_ROWS, 64))
    x *= (np.exp(spread * rng.standard_normal(len(x))) / np.linalg.norm(x, axis=1))[:, None]
    ids = np.arange(len(x))
    asked = ids[::80]
    q, i, _ = ann.MultiprobeIndex(ids, x, np.linalg.norm(x, axis=1).max()).search(asked, x[asked], 20)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    wanted = {(a, b) for a, row in zip(asked.tolist(), np.argsort(-scores, axis=1)[:, :20].tolist()) for b in row}
    assert len(wanted & set(zip(q.tolist(), i.tolist()))) / len(wanted) >= 0.98


def test_probes_come_in_order_of_estimated_success():
    m = 4
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    sets = ann.probe_sets(m, 80)
    costs = [sum(expected[j] for j in s) for s in sets]
    assert len(set(sets)) == 80 and costs == pytest.approx(sorted(costs))
    assert all(2 * m - 1 - j not in s for s in sets for j in s)
