"""Minimax contiguous sharding of atomic groups.

Rows with equal text are one group and stay together. Groups are ordered by the digest of their text,
and the ordered list is cut into shards so that the largest shard is as small as it can be: a binary
search finds the smallest capacity for which greedy filling needs no more shards than there are.

The prefix sums of the groups stay distributed. The search sees at most MAX_KNOWN boundaries at a
time: it brackets the capacity with those it knows, asks for the boundaries near the open cuts, and
repeats until the bracket closes. Only DataFrame functions touch rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 24
LAW = "bytes"
#: Overhead of a row in its shard.
ROW_BYTES = 8
#: First cut of the digest order: a bounded number of buckets.
BUCKETS = 4096
#: Group boundaries that the search may ask for at once.
MAX_KNOWN = 50_000
#: Rows of a group that are numbered at once, about: a larger group is numbered in parts, each on its own.
PART_ROWS = 100_000


class Boundaries:
    """Sorted (end, rank) of known group boundaries; single[i]: only one group lies before ends[i] and after the one before."""

    def __init__(self, points: list[tuple[int, int]]):
        points = sorted(set(points) | {(0, 0)})
        self.ends = [e for e, _ in points]
        self.ranks = [r for _, r in points]
        self.single = [True] + [b - a <= 1 for a, b in zip(self.ranks, self.ranks[1:])]

    @property
    def total(self) -> int:
        return self.ends[-1]

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Ends of greedily filled shards. Where groups between known boundaries are unknown, hopeful: cut
        as far as the capacity goes; else at the known boundary before."""
        out, at = [], 0
        for _ in range(shards):
            target = at + capacity
            i = bisect.bisect_right(self.ends, target) - 1
            inside = i + 1 < len(self.ends) and not self.single[i + 1]
            at = target if hopeful and inside else max(self.ends[i], at)
            out.append(at)
        return out

    def smallest(self, low: int, shards: int, hopeful: bool) -> int:
        """The smallest capacity from low on with which greedy filling reaches the end."""
        high = max(low, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, hopeful)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def open_gaps(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """Gaps of several groups that a cut may lie in for a capacity from low to high."""
        near = zip(self.cuts(low, shards, False), self.cuts(high, shards, True))
        wanted = set()
        for a, b in near:
            first, last = bisect.bisect_left(self.ends, a), bisect.bisect_left(self.ends, min(b, self.total))
            wanted.update(i for i in range(max(first, 1), min(last, len(self.ends) - 1) + 1) if not self.single[i])
        return [(self.ends[i - 1], self.ends[i]) for i in sorted(wanted)]


def _groups(rows: DataFrame) -> DataFrame:
    """One row a group in digest order: end and rank (counted in groups), and first row's number."""
    parts = rows.groupBy("bucket", "digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    buckets = parts.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.count("*").alias("g"), F.sum("n").alias("m"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # BUCKETS rows at most: one task can sum them, and any task can hold them.
    starts = buckets.select("bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "bgm"])
    inside = Window.partitionBy("bucket").orderBy("digest")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.join(F.broadcast(starts), "bucket").select(
        "bucket",
        "digest",
        "bytes",
        (F.col("b0") + F.sum("bytes").over(upto)).alias("end"),
        (F.col("g0") + F.row_number().over(inside)).alias("rank"),
        (F.col("m0") + F.sum("n").over(upto) - F.col("n")).alias("first_row"),
        "n",
    )


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Ends (in bytes) of the shards: greedy filling with the smallest capacity that needs no more than shards."""
    known = [(r["e"], r["r"]) for r in groups.groupBy("bucket").agg(F.max("end").alias("e"), F.max("rank").alias("r")).collect()]
    if not known:
        return [0] * shards
    largest = groups.agg(F.max("bytes")).first()[0]
    bounds = Boundaries(known)
    low = max(largest, -(-bounds.total // shards))
    while True:
        low = bounds.smallest(low, shards, hopeful=True)
        high = bounds.smallest(low, shards, hopeful=False)
        gaps = bounds.open_gaps(low, high, shards)
        if low == high and not gaps or not gaps:
            return bounds.cuts(high, shards, hopeful=False)
        ranks = dict(zip(bounds.ends, bounds.ranks))
        unknown = sum(ranks[b] - ranks[a] for a, b in gaps)
        # half of the largest gap at most, so that each round learns of a boundary inside it
        stride = max(1, min(-(-unknown // MAX_KNOWN), max((ranks[b] - ranks[a] for a, b in gaps), default=2) // 2))
        merged: list[list[int]] = []
        for a, b in gaps:
            if merged and merged[-1][1] == a:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        near = F.lit(False)
        for a, b in merged:
            near = near | F.col("end").between(a + 1, b)
        more = groups.filter(near & (F.col("rank") % stride == 0)).select("end", "rank").collect()
        known += [(r["end"], r["rank"]) for r in more]
        bounds = Boundaries(known)


def _shard(end: Column, cuts: list[int]) -> Column:
    """Number of the first shard whose end is not before the group's."""
    return F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c < end))


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    size: UTF-8 bytes of the text plus ROW_BYTES. Rows with equal text share a shard; null texts are
    a group of their own (size ROW_BYTES, text_crc32 null). slot counts the rows of a shard from 0
    without gaps. law is ``bytes``; grown_shard is null under it. Repeated rows get a slot each. Of
    fewer groups than shards, some shards stay empty; an empty table gives no rows. Other columns are
    not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    binary = F.col(text).cast("binary")
    rows = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
            F.crc32(binary).alias("text_crc32"),
            # "" sorts the group of null texts first
            F.coalesce(F.sha2(binary, 256), F.lit("")).alias("digest"),
        )
        # the first 32 bits of the digest, cut to so many buckets in the digest's order
        .withColumn("bucket", F.coalesce(F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") * BUCKETS / 2**32).cast("int"), F.lit(0))),
        "rows",
    )
    groups = materialize(_groups(rows), "groups")
    salts = -(-(groups.agg(F.max("n")).first()[0] or 1) // PART_ROWS)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    cuts = minimax_cuts(groups, shards)
    placed = groups.select("digest", _shard(F.col("end"), cuts).alias("shard"), "first_row")
    ahead = placed.groupBy("shard").agg(F.min("first_row").alias("shard_row"))  # one row a shard
    placed = placed.join(F.broadcast(ahead), "shard")
    # A large group is numbered in parts; where a part begins comes from counts of the parts.
    parts = rows.groupBy("digest", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("digest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("digest", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_row"))
    inside = Window.partitionBy("digest", "salt").orderBy("doc_id")
    return (
        rows.withColumn("i", F.row_number().over(inside) - 1)
        .join(parts.join(placed, "digest"), ["digest", "salt"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("first_row") - F.col("shard_row") + F.col("part_row") + F.col("i")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
