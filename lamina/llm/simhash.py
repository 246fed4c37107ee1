"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit positions gets a non-zero vector of r + 1 bits. The mask of a non-zero vector v keeps
the positions whose vector has odd parity with v. The positions in which two fingerprints at distance
r or less differ span at most r dimensions, so some v is orthogonal to them all, and under its mask the
two are equal: every pair within the radius collides in one of the 2^(r+1) - 1 tables.

Equal fingerprints are one node. A bucket of two nodes gives its pair from its least and greatest
member; up to BUCKET_PAIRS members are compared in a join that only lets links out. In larger
buckets no pairs are formed: their nodes meet at midpoints instead. Two fingerprints are within 2q exactly
if some value lies within q of both, and all that share such a value are linked, so each midpoint needs one
star only and the work is linear in the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.components import components

from .common import keep_first, materialize, named

BITS = 64
RADIUS = 4
SHINGLE = 4
HASH_SEED = 42
#: Distinct fingerprints of a bucket that are compared with each other.
BUCKET_PAIRS = 128


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536])), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The masks, as signed 64-bit numbers. Position i has the vector i mod (2^(radius+1) - 1) + 1."""
    count = 2 ** (radius + 1) - 1
    vectors = [i % count + 1 for i in range(bits)]
    masks = [sum(1 << i for i, v in enumerate(vectors) if (v & m).bit_count() % 2) for m in range(1, count + 1)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _flips(up_to: int) -> list[list[int]]:
    """By the number of bits set, up to up_to: all such 64-bit numbers, signed."""
    found = [[sum(1 << i for i in c) for c in combinations(range(BITS), k)] for k in range(up_to + 1)]
    return [[x - 2**64 if x >= 2**63 else x for x in some] for some in found]


def near_links(nodes: DataFrame, radius: int = RADIUS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints fp, enough to connect all pairs within radius.

    Every link is within radius; links that others imply may be missing only in large buckets.
    """
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks(radius))]
    placed = nodes.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.*")
    buckets = materialize(
        placed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets"
    )
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    twos = buckets.filter("n = 2").select("a", "b").filter(within)
    if not buckets.filter("n > 2").limit(1).count():
        return twos.distinct()
    members = materialize(placed.join(buckets.filter("n > 2").select("t", "key", "n"), ["t", "key"]), "members")
    few = members.filter(F.col("n") <= bucket_pairs)
    left, right = few.select("t", "key", F.col("fp").alias("a")), few.select("t", "key", F.col("fp").alias("b"))
    some = left.join(right, ["t", "key"]).filter((F.col("a") < F.col("b")) & within).select("a", "b")
    links = twos.unionByName(some)
    many = members.filter(F.col("n") > bucket_pairs).select("fp").distinct()
    if many.limit(1).count():
        links = links.unionByName(_midpoint_links(materialize(many, "many"), radius))
    return links.distinct()


def _midpoint_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Stars through midpoints: linear in nodes, exact for every radius.

    Two fingerprints are within the radius exactly if a value lies within radius // 2 bits of one and within the rest of
    the radius of the other. Of those within the lesser reach of a value one is the centre, to which all others in reach are tied.
    """
    inner, outer = radius // 2, radius - radius // 2
    steps = [F.array(*map(F.lit, some)) for some in _flips(outer)]
    reach = [nodes.select("fp", F.explode(F.transform(some, lambda x: x.bitwiseXOR(F.col("fp")))).alias("middle"), F.lit(k <= inner).alias("near")) for k, some in enumerate(steps)]
    reach = reduce(DataFrame.unionByName, reach)
    stars = reach.groupBy("middle").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("centre"), F.count("*").alias("n")).filter("n > 1 and centre is not null")
    met = reach.join(stars.select("middle", "centre"), "middle").filter("fp <> centre")
    return met.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")).distinct()


def _grouped(docs: DataFrame, radius: int, shingle: int, bucket_pairs: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, mark (a hash of the text), fp and component_id of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "mark", "fp"])

    rows = docs.select(named(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(named(text)).alias("mark"), named(text).alias("text"))
    rows = materialize(rows.mapInArrow(made, "doc_id bigint, mark bigint, fp bigint"), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(near_links(nodes, radius, bucket_pairs))
    groups = materialize(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group")), "fp_groups")
    least = materialize(groups.groupBy("group").agg(F.min("least").alias("component_id")), "fp_least")
    # Written tables on both sides: Spark may split the join where many rows share a fingerprint or a group.
    named_groups = materialize(groups.join(least, "group").select("fp", "component_id"), "fp_components")
    return rows.join(named_groups, "fp").select("doc_id", "mark", "fp", "component_id")


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket_pairs: int = BUCKET_PAIRS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Return doc_id, fp (signed 64-bit) and component_id for every row of docs.

    component_id is the smallest doc_id that links of at most radius differing bits reach, the own one
    included. Null and wordless texts have fp 0 and link like any other; texts shorter than a shingle
    hash as a whole, texts of any length are hashed whole. Rows with a null id take part and get the component's id, null
    if it has no other. Repeated rows are linked. An empty table gives no rows; other columns are not read, whatever their names.
    """
    return _grouped(docs, radius, shingle, bucket_pairs, doc_id, text).select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket_pairs: int = BUCKET_PAIRS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """docs without the near duplicates: of each component the row of the smallest doc_id stays, then of the least fingerprint and text.

    Of rows that repeat that id and text one stays. Rows of null id stay, as nothing names their component. An empty table
    gives no rows. Columns may have any names; all are returned.
    """
    rows = _grouped(docs, radius, shingle, bucket_pairs, doc_id, text).filter("doc_id is not null")
    return keep_first(docs, rows.select(F.col("doc_id").alias("doc"), "mark", F.col("fp").alias("node"), F.col("component_id").alias("group")), doc_id, text)
