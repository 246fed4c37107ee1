"""The pipeline's near-duplicate stage against sets compared one by one."""

import random
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from lamina.llm import near_texts, simhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

SCHEMA = "doc_id bigint, text string"


def grams(text):
    words = (text or "").lower().encode().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(rows):
    sets = {i: grams(t) for i, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))}


def colliding(rows, pairs):
    """The pairs that are equal under some mask in some block, or have equal sets."""
    sets = dict(zip([i for i, _ in rows], near_texts.shingles([(t or "").encode() for _, t in rows])))
    prints = dict(zip(sets, near_texts.fingerprints(list(sets.values())).tolist()))
    masks = [m % 2**64 for m in simhash.covering_masks(near_texts.RADIUS)]

    def met(a, b):
        apart = [x ^ y for x, y in zip(prints[a], prints[b])]
        close = sum(x.bit_count() for x in apart) <= near_texts.FURTHEST
        return np.array_equal(sets[a], sets[b]) or close and any(not x & m for x in apart for m in masks)

    return {(a, b) for a, b in pairs if met(a, b)}


def firsts(rows, pairs):
    return set(brute.groups(pairs, {i for i, _ in rows}).values())


def varied(seed=3):
    """Texts of many lengths with copies in which some words are others, on both sides of 0.8."""
    rng, rows = random.Random(seed), []
    for _ in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 4, 5, 6, 12, 60, 300]))]
        rows.append(" ".join(words))
        for share in (0.0, 0.005, 0.01, 0.02, 0.03):
            rows.append(" ".join(f"x{rng.randrange(4000)}" if rng.random() < share else w for w in words))
    rows += [None, "", " \n", "One two", "one TWO"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def crowd(n=300, seed=5):
    """Near copies of one text, each with another word, among texts that are like no other."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    rows = [" ".join(words[:k] + [f"y{i}"] + words[k + 1 :]) for i in range(n) for k in [rng.randrange(200)]]
    return list(enumerate(rows + [" ".join(f"z{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)]))


@pytest.mark.parametrize("bucket_pairs", [32, 2])
@pytest.mark.parametrize("rows", [varied(), crowd()], ids=["varied", "crowd"])
def test_keeps_one_of_each_group(spark, bucket_pairs, rows):
    found = near_texts.keep_one(spark.createDataFrame(rows, SCHEMA), bucket_pairs=bucket_pairs).collect()
    assert len(found) == len({r.doc_id for r in found})
    assert {r.doc_id for r in found} == firsts(rows, colliding(rows, similar(rows)))


def test_most_similar_pairs_collide():
    rows = [(i, t) for seed in range(4) for i, t in ((1000 * seed + i, t) for i, t in varied(seed)) if len(grams(t)) > 50]
    pairs = similar(rows)
    found = colliding(rows, pairs)
    assert len(found) > 0.9 * len(pairs)
    # copies that go, of those that should
    assert len(rows) - len(firsts(rows, found)) > 0.9 * (len(rows) - len(firsts(rows, pairs)))


@pytest.mark.parametrize("size", [1, 5, 255, 256, 1000])
def test_fingerprints_count_bits(size):
    rng = np.random.default_rng(size)
    sets = [rng.integers(0, 2**64, n, np.uint64) for n in (size, 0, 3, 2 * size)]
    found = near_texts.fingerprints(sets, 1)[:, 0].tolist()
    for hashes, value in zip(sets, found):
        mixed = [int(h) for h in near_texts.mix(hashes)]
        assert value == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed))


def test_runs_over_batches_and_tasks():
    """Pairs of short whole runs come out, everything else is left to the others: no place gets lost."""
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 60, 400) ** 2 // 7)
    nodes = np.concatenate([np.sort(rng.permutation(1000)[:n]) for n in np.unique(keys, return_counts=True)[1]])
    for step in (1, 7, 50, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + step]), pa.array(nodes[a : a + step])], ["key", "node"]) for a in range(0, 400, step)]
        out = [r for b in near_texts._met(6)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        pairs, rest = {(x, y) for large, x, y in out if not large}, {(x, y) for large, x, y in out if large}
        first, last = keys[0], keys[-1]
        wanted, left = set(), set()
        for key in np.unique(keys).tolist():
            own = nodes[keys == key].tolist()
            if key in (first, last) or len(own) > 6:
                left |= {(key, n) for n in own}
            else:
                wanted |= {(a, b) for a in own for b in own if a < b}
        assert pairs == wanted and rest == left and sum(1 for x in out if x[0]) == len(left)


def test_stage_drops_copies_with_a_few_other_words(spark, sf_dir):
    words = [f"w{k}" for k in range(300)]
    near = words.copy()
    near[40] = near[140] = near[240] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:150] + near[:150]))]
    assert {r.doc_id for r in corpus_pipeline.texts_once(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()} == {1, 3}


def test_odd_rows_and_columns(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(5, text), (5, text), (5, "else " * 9), (None, text), (None, None), (7, None), (8, " "), (4, text + " end"), (9, "x" * 100_000)]
    odd = spark.createDataFrame(rows, SCHEMA).withColumn("kept_id", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("group", F.lit(3)).withColumn("KEPT_MARK", F.lit(4))
    found = near_texts.keep_one(odd)
    assert found.columns == odd.columns
    # of 4, 5 and 5 the smallest; the other text under 5 is another group; null ids stay; 7 and 8 are wordless
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == sorted(
        [(4, text + " end"), (5, "else " * 9), (None, text), (None, None), (7, None), (9, "x" * 100_000)], key=str
    )
    assert near_texts.keep_one(odd.limit(0)).count() == 0


def test_repeated_rows(spark):
    rows = [(5, "one two three four five six")] * 3 + [(6, "something else here")]
    assert sorted(r.doc_id for r in near_texts.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == [5, 6]
