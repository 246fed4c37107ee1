"""Near-duplicate texts by SimHash: sets of word shingles with a Jaccard similarity of 0.8 or more.

A text's set of shingles gets BLOCKS SimHash fingerprints of 64 bits, each from its own hashes: one wide SimHash in
blocks. The covering masks of a radius are applied to every block, so that two sets collide in some table for certain if
any of their blocks is within the radius: all pairs within BLOCKS * (RADIUS + 1) - 1 of the wide bits, and most of those
further apart. Pairs that collide are kept if the wide fingerprints allow the similarity, and then confirmed on the whole
sets. The README has the share of similar pairs that collide.

Equal sets are one node. Places (table, key) are dealt by ranges of key and node, so that a common key is split over
tasks; sorted, a key's nodes are neighbours. All pairs of up to BUCKET_PAIRS nodes are compared. Where more share a key,
or its run is cut by the end of a task, all are compared with the least node first, and then only those with each
other that no links connect yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.components import components

from .common import NO_ID, keep_first, materialize, named, slices, worker
from .simhash import HASH_SEED, covering_masks
from .words import ODD, mix, phrases, word_hashes

SHINGLE = 5
#: Blocks of 64 bits, and the radius that the masks of a block cover: 31 tables a block.
BLOCKS, RADIUS = 8, 4
#: Differing bits of all blocks that are still compared: those expected of similarity 0.8, and so many deviations more.
EXPECTED = math.acos(8 / 9) / math.pi
FURTHEST = math.ceil(64 * BLOCKS * EXPECTED + 3.5 * math.sqrt(64 * BLOCKS * EXPECTED * (1 - EXPECTED)))
#: Nodes of a key that are compared with each other at once.
BUCKET_PAIRS = 32
SLICE_BYTES = 1 << 20
_LANES = np.uint64(0x0101010101010101)


def shingles(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text the distinct hashes of its word shingles, ascending. A shorter text is one shingle, a wordless one has none."""
    texts = [t.lower() for t in texts]  # of bytes: A-Z only
    hashes, offsets = word_hashes(texts)
    runs = phrases(hashes, shingle, ODD[1])
    out = []
    for i, text in enumerate(texts):
        first, last = int(offsets[i]), int(offsets[i + 1])
        if last - first >= shingle:
            out.append(np.unique(runs[first : last - shingle + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(text.split()), HASH_SEED)] * (last > first), np.uint64))
    return out


def fingerprints(sets: list[np.ndarray], blocks: int = BLOCKS) -> np.ndarray:
    """A row of fingerprints for each set; zeros for an empty one. A bit is 1 if it is in over half of the hashes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), blocks), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, sizes = np.concatenate(sets), sizes[full]
    # bytes of a number count up to 255 bits side by side, so sums are made of parts of so many hashes
    starts = np.cumsum(sizes) - sizes
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    for block in range(blocks):
        with np.errstate(over="ignore"):
            hashes = mix(flat + np.uint64(block) * np.uint64(0x9E3779B97F4A7C15))
        for shift in range(8):
            lanes = np.add.reduceat(hashes >> np.uint64(shift) & _LANES, cuts)
            ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
            bits = (2 * ones > sizes[:, None]).astype(np.uint8)
            out[full, block] |= np.ascontiguousarray(bits).view(np.uint64).ravel() << np.uint64(shift)
    return out


def _prints(docs: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """doc, mark (a hash of the text), node (a hash of the set), n (its size) and fingerprints f0, f1, ... of every row."""
    rows = docs.select(F.coalesce(named(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(named(text)).alias("mark"), named(text).alias("text"))
    columns = [f"f{i}" for i in range(BLOCKS)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker():
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    sets = shingles(_bytes(part.column("text")), shingle)
                    found = fingerprints(sets).view(np.int64)
                    node = np.array([xxhash.xxh64_intdigest(s.tobytes(), HASH_SEED) for s in sets], np.uint64).view(np.int64)
                    sizes = pa.array([len(s) for s in sets], pa.int64())
                    arrays = [part.column("doc"), part.column("mark"), pa.array(node), sizes, *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(BLOCKS))]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc", "mark", "node", "n", *columns])

    kinds = ", ".join(f"{c} bigint" for c in ["doc", "mark", "node", "n", *columns])
    return materialize(rows.mapInArrow(made, kinds), "near_prints")


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).fill_null(b"").to_pylist()


def _met(bucket_pairs: int):
    """From sorted (key, node) of a task: pairs of nodes that share a key, and the places of keys that are met elsewhere."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(large: bool, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), large)), pa.array(x), pa.array(y)], ["large", "x", "y"])

        def whole(keys: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole runs of equal keys."""
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            size = np.repeat(sizes, sizes)
            elsewhere = size > bucket_pairs
            for key in cut:
                elsewhere |= keys == key
            if elsewhere.any():
                yield rows(True, keys[elsewhere], nodes[elsewhere])
            some = ~elsewhere & (size > 1)
            keys, nodes = keys[some], nodes[some]
            for step in range(1, int(sizes.max(initial=0))):
                at = np.flatnonzero(keys[step:] == keys[:-step]) if step < len(keys) else []
                if not len(at):
                    break
                yield rows(False, nodes[at], nodes[at + step])

        held = [np.zeros(0, np.int64)] * 2
        cut: list[np.int64] = []  # the first key, which the task before may have more of, and the last whose run was too long to hold
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = (np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns))
            cut = cut or [keys[0]]
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield from whole(keys[:last], nodes[:last])
            held = [keys[last:], nodes[last:]]
            if len(held[0]) > bucket_pairs:
                yield rows(True, *held)
                cut, held = [cut[0], keys[-1]], [np.zeros(0, np.int64)] * 2
        yield rows(True, *held)  # the task after may have more of it

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker():
            yield from scan(batches)

    return task


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    held = ["n", *(f"f{i}" for i in range(BLOCKS))]
    one, two = (nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in held]) for s in "ab")
    apart = sum((F.bit_count(F.col(f"f{i}_a").bitwiseXOR(F.col(f"f{i}_b"))) for i in range(BLOCKS)), F.lit(0))
    able = (5 * F.col("n_a") >= 4 * F.col("n_b")) & (5 * F.col("n_b") >= 4 * F.col("n_a")) & (apart <= FURTHEST)
    pairs = materialize(pairs.distinct().join(one, "a").join(two, "b").filter(able).select("a", "b"), "near_pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = materialize(asked.join(nodes, "node").select("node", "doc", "mark"), "near_asked")
    rows = docs.select(F.coalesce(named(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(named(text)).alias("mark"), named(text).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker():
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    sets = [s.view(np.int64) for s in shingles(_bytes(part.column("text")), shingle)]
                    yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    texts = rows.join(asked, ["doc", "mark"]).select("node", "text")
    sets = materialize(texts.mapInArrow(made, "node bigint, hashes array<bigint>").dropDuplicates(["node"]), "near_sets")
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab")
    shared, total = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return materialize(pairs.join(left, "a").join(right, "b").filter(9 * shared >= 4 * total).select("a", "b"), "near_links")


def near_texts(docs: DataFrame, shingle: int = SHINGLE, bucket_pairs: int = BUCKET_PAIRS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc (the id), mark (a hash of the text), node (of its set of shingles) and group for every row of docs.

    Rows are in one group if similar pairs that collide connect them. Null and wordless texts have the empty set and are
    alike; texts shorter than a shingle are alike if their words are the same. Null ids count as the greatest.
    An empty table gives no rows; other columns are not read.
    """
    prints = _prints(docs, shingle, doc_id, text)
    blocks = [f"f{i}" for i in range(BLOCKS)]
    least = [F.min(c).alias(c) for c in ["n", *blocks]]  # equal in all rows of a node
    nodes = materialize(prints.groupBy("node").agg(F.min("doc").alias("doc"), F.min_by("mark", "doc").alias("mark"), *least), "near_nodes")
    masks = covering_masks(RADIUS)
    wide = nodes.filter("n > 0").select("node", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col(c).alias("f")) for i, c in enumerate(blocks)])).alias("x"))
    keys = F.array(*[F.xxhash64("x.block", F.lit(t), F.col("x.f").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])
    placed = wide.select(F.explode(keys).alias("key"), "node")
    dealt = placed.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    met = materialize(dealt.mapInArrow(_met(bucket_pairs), "large boolean, x bigint, y bigint"), "near_met")
    pairs = met.filter("not large").select(F.col("x").alias("a"), F.col("y").alias("b"))
    members = met.filter("large").select(F.col("x").alias("key"), F.col("y").alias("node"))
    shared = members.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    many = materialize(members.join(shared, "key").select("key", "node", "first"), "near_many")
    stars = many.filter("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = _alike(pairs.unionByName(stars), nodes, docs, shingle, doc_id, text)
    if many.limit(1).count():
        grouped = many.join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("group"))
        mixed = grouped.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x < y").select("key")
        grouped = materialize(grouped.join(mixed, "key"), "near_mixed")
        one, two = (grouped.select("key", F.col("node").alias(s), F.col("group").alias(f"group_{s}")) for s in "ab")
        rest = one.join(two, "key").filter("a < b and group_a <> group_b").select("a", "b")
        links = links.unionByName(_alike(rest, nodes, docs, shingle, doc_id, text))
    found = components(links).withColumnRenamed("component", "group")
    return prints.select("doc", "mark", "node").join(found, "node", "left").withColumn("group", F.coalesce("group", "node"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the near duplicates: of each group the row of the smallest doc_id stays, then of the least node and mark.

    Of rows that repeat that id and text one stays. Rows of null id stay, as nothing names their group. Null and
    wordless texts are one group. An empty table gives no rows. Columns may have any names; all are returned.
    """
    rows = near_texts(docs, doc_id=doc_id, text=text, **options).filter(F.col("doc") != NO_ID)
    return keep_first(docs, rows, doc_id, text)
