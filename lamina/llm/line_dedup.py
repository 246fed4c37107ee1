"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

``references`` holds every (line key, document) with how often the line occurs there: it is exact, and
counts come from it. ``filters`` holds, for each shard of keys, a cuckoo filter of the keys that several
documents share. Lines are dropped by probing the filters first: what they reject, nearly all lines, is
done; what they let through is confirmed against the exact counts. As a cuckoo filter can forget a key,
deleting documents undoes what they caused: a key that only one document still holds leaves its
filter, and its lines come back.

A change touches only the keys of the documents that come or go: their references are counted again, and the
filters of their shards are changed; all other tables are read on as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, ascii_lower, materialize, named, unused, worker
from .cuckoo import CuckooFilter

MIN_LENGTH = 10
BLANKS = " \t\n\x0b\x0c\r"
#: Shared keys of a filter, and references probed by one task: what a task holds.
KEYS_PER_SHARD, ROWS_PER_CHUNK = 100_000, 20_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _id(doc_id: str) -> Column:
    return F.coalesce(named(doc_id).cast("bigint"), F.lit(NO_ID))


def references(docs: DataFrame, min_length: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each (digest of a line key, document): doc, digest, h (64-bit hash), lines."""
    lines = docs.select(_id(doc_id).alias("doc"), F.explode(_split(named(text))).alias("line"))
    keys = lines.select("doc", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_length)
    keys = keys.select("doc", F.unhex(F.sha2("key", 256)).alias("digest"))
    return keys.groupBy("doc", "digest").agg(F.count("*").alias("lines")).withColumn("h", F.xxhash64("digest"))


def _shared(refs: DataFrame) -> DataFrame:
    """The keys that several documents hold, with the owner that keeps its lines."""
    counts = refs.groupBy("digest", "h").agg(F.count("*").alias("docs"), F.min("doc").alias("owner"))
    return counts.filter("docs > 1")


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.sized(2 * len(rows))  # room to grow
    made.insert(rows["h"].to_numpy())
    return pd.DataFrame({"shard": [key[0]], "keys": [len(rows)], "filter": [made.to_bytes()]})


def _update(key: tuple, filters: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.from_bytes(filters["filter"].iloc[0]) if len(filters) else CuckooFilter.sized(2 * len(changes))
    gone = changes["change"].to_numpy() < 0
    made.delete(changes["h"].to_numpy()[gone])
    made.insert(changes["h"].to_numpy()[~gone])
    keys = (int(filters["keys"].iloc[0]) if len(filters) else 0) + int((~gone).sum()) - int(gone.sum())
    return pd.DataFrame({"shard": [key[0]], "keys": [keys], "filter": [made.to_bytes()]})


def _probe(refs: pa.Table, filters: pa.Table) -> pa.Table:
    if not len(filters) or not len(refs):
        return refs.select(["doc", "digest"]).slice(0, 0)
    with worker():
        held = CuckooFilter.from_bytes(filters.column("filter")[0].as_py())
        return refs.select(["doc", "digest"]).filter(pa.array(held.contains(refs.column("h").to_numpy())))


@dataclass
class LineIndex:
    """The state: exact references, shared keys and one filter a shard, each a table in the shared folder."""

    references: DataFrame
    shared: DataFrame
    filters: DataFrame
    shards: int
    min_length: int = MIN_LENGTH

    @classmethod
    def build(cls, docs: DataFrame, min_length: int = MIN_LENGTH, **names: str) -> LineIndex:
        return cls._of(materialize(references(docs, min_length, **names), "references"), min_length)

    @classmethod
    def _of(cls, refs: DataFrame, min_length: int) -> LineIndex:
        shared = materialize(_shared(refs), "shared")
        shards = max(1, -(-shared.count() // KEYS_PER_SHARD))
        sharded = shared.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h")
        filters = sharded.groupBy("shard").applyInPandas(_build, "shard int, keys bigint, filter binary")
        return cls(refs, shared, materialize(filters, "filters"), shards, min_length)

    def insert(self, docs: DataFrame, **names: str) -> LineIndex:
        """The index with documents added. Their ids must be new: an id that already holds one of their lines is refused."""
        added = materialize(references(docs, self.min_length, **names), "added")
        old = self._touched(added)
        if old.join(added, ["doc", "digest"], "left_semi").limit(1).count():
            raise ValueError("documents to insert are in the index already")
        return self._changed(self.references.unionByName(added), added, old, old.unionByName(added))

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """The index without the documents of these ids; ids that it doesn't hold change nothing."""
        gone = materialize(ids.select(_id(doc_id).alias("doc")).distinct(), "gone")
        removed = materialize(self.references.join(gone, "doc", "left_semi"), "removed")
        old = self._touched(removed)
        return self._changed(self.references.join(gone, "doc", "left_anti"), removed, old, old.join(gone, "doc", "left_anti"))

    def _touched(self, changed: DataFrame) -> DataFrame:
        """The references that share a key with changed ones."""
        return materialize(self.references.join(changed.select("digest").distinct(), "digest", "left_semi"), "touched")

    def _changed(self, refs: DataFrame, changed: DataFrame, old: DataFrame, new: DataFrame) -> LineIndex:
        """Filters take in keys that became shared and forget those that no longer are. All are made anew where the
        shared keys have outgrown their shards."""
        before, after = materialize(_shared(old), "before"), materialize(_shared(new), "after")
        came = after.join(before, "digest", "left_anti").select("h", F.lit(1).alias("change"))
        went = before.join(after, "digest", "left_anti").select("h", F.lit(-1).alias("change"))
        changes = materialize(came.unionByName(went).withColumn("shard", F.pmod("h", F.lit(self.shards)).cast("int")), "changes")
        keys = self.filters.agg(F.sum("keys")).first()[0] or 0
        if keys + (changes.agg(F.sum("change")).first()[0] or 0) > 1.5 * self.shards * KEYS_PER_SHARD:
            return self._of(materialize(refs, "references"), self.min_length)
        shared = self.shared.join(changed.select("digest").distinct(), "digest", "left_anti").unionByName(after)
        shards = changes.select("shard").distinct()
        updated = self.filters.join(shards, "shard", "left_semi").groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(
            lambda key, a, b: _update(key, a, b), "shard int, keys bigint, filter binary"
        )
        filters = self.filters.join(shards, "shard", "left_anti").unionByName(materialize(updated, "updated"))
        return LineIndex(refs, shared, filters, self.shards, self.min_length)

    def compact(self) -> LineIndex:
        """The same index in tables of its own, without what changes have left behind."""
        return LineIndex(materialize(self.references, "references"), materialize(self.shared, "shared"), materialize(self.filters, "filters"), self.shards, self.min_length)

    def drops(self) -> DataFrame:
        """The (doc, digest) whose lines go: shared keys outside their owner, found by filter and then confirmed."""
        refs = self.references.withColumn("shard", F.pmod("h", F.lit(self.shards)).cast("int"))
        # A task's worth of references each, so that a shard with a very common line is many tasks. The table has a row
        # for each shard; as it is written, Spark knows its size and broadcasts it only while it is small.
        sizes = materialize(refs.groupBy("shard").agg(F.ceil(F.count("*") / ROWS_PER_CHUNK).cast("int").alias("chunks")), "sizes")
        refs = refs.join(sizes, "shard").withColumn("chunk", F.pmod(F.xxhash64("doc", "digest"), "chunks").cast("int"))
        filters = self.filters.join(sizes, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        found = (
            refs.select("shard", "chunk", "doc", "digest", "h")
            .groupBy("shard", "chunk")
            .cogroup(filters.select("shard", "chunk", "filter").groupBy("shard", "chunk"))
            .applyInArrow(_probe, "doc bigint, digest binary")
        )
        return found.join(self.shared, "digest").filter("doc <> owner").select("doc", "digest")

    def dedup(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """docs (that were put in) with kept_text, n_lines and n_dropped; see dedup_lines."""
        lists = self.drops().groupBy("doc").agg(F.collect_list("digest").alias("drops"))
        doc, drops = unused(docs, "line_doc"), unused(docs, "line_drops")
        rows = docs.withColumn(doc, _id(doc_id)).join(lists.select(F.col("doc").alias(doc), F.col("drops").alias(drops)), doc, "left")
        others = [named(c).alias(c) for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")]
        made = rows.select(F.struct(*others).alias("row"), _rebuilder(self.min_length)(named(text), F.col(drops)).alias("made"))
        return made.select("row", "made.kept_text", "made.n_lines", "made.n_dropped")


def _rebuilder(min_length: int):
    """The column function from a text and the digests of its lines that go to what is left of it."""

    @F.arrow_udf("kept_text string, n_lines bigint, n_dropped bigint")
    def rebuild(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with worker():
            for whole, lists in batches:
                texts, counts, dropped = [], [], []
                for value, drops in zip(whole, lists):
                    value = value.as_py() or ""
                    lines = value.split("\n")
                    counts.append(len(lines))
                    if drops.is_valid:
                        gone, kept = set(drops.as_py()), []
                        for line in lines:
                            key = line.strip(BLANKS).encode().lower()
                            if not (len(key) >= min_length and hashlib.sha256(key).digest() in gone and len(key.decode()) >= min_length):
                                kept.append(line)
                        value, lines = "\n".join(kept), kept
                    texts.append(value)
                    dropped.append(counts[-1] - len(lines))
                columns = [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.StructArray.from_arrays(columns, ["kept_text", "n_lines", "n_dropped"])

    return rebuild


def dedup_lines(docs: DataFrame, min_length: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return row (a struct of the other columns of docs), kept_text, n_lines, n_dropped for every row.

    Texts are cut at newlines; a null or empty one is one empty line. A line's key is the line without
    ASCII blanks at its ends and with A-Z lower-cased. Keys of min_length code points or more that two or more
    documents hold lose their lines outside the smallest doc_id that holds them. Rows that repeat an
    id are one document; rows of null id are one document after all others. Texts of any length are taken whole. An empty
    table gives no rows. Columns of docs may have any names, as they are in row.
    """
    return LineIndex.build(docs, min_length, doc_id=doc_id, text=text).dedup(docs, doc_id, text)


def oracle_sql(min_length: int = MIN_LENGTH) -> str:
    """The production query as one SQL statement over documents."""
    return f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, min(doc_id) as owner from k where length(key) >= {min_length} group by key having count(distinct doc_id) > 1),
m as (select k.*, coalesce(k.doc_id <> s.owner, false) as dropped from k left join s using (key))
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from m group by doc_id
"""
