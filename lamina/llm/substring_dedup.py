"""Substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words. Every window has an anchor, the least hash of its TILE-word phrases,
so windows that are equal have equal anchors, and a text has few. The steps:

1. sketch: words and anchors of every document; no text is moved.
2. candidates: documents with an anchor that different texts share.
3. confirm: of their windows, those that several documents hold, each with its owner (the smallest doc_id).
   Runs of such windows in an owner are its recurring passages.
4. automata: passages are dealt to shards of bounded size. A shard's Aho-Corasick automaton holds the
   passages cut into tiles of TILE words, at multiples of TILE: any window of a passage contains a whole
   tile. Documents are streamed through the automata of the shards that they share an anchor with; a
   tile found points to the windows around it, which are compared word by word with those of the passages.
   Of a document only the windows go to a shard whose anchors its passages have.
5. words covered by occurrences outside the owner go.

Windows and anchors meet as hashes, but what is removed has been compared word by word. Copies of a
whole text are settled by its digest: all their windows are the first copy's.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import release

from .common import NO_ID, materialize, named, slices
from .words import ODD, phrases, word_hashes

WINDOW, TILE = 50, 25
#: Words of the passages of one automaton, words of the documents streamed through it by one task,
#: words of one passage (longer ones are cut with overlap).
SHARD_WORDS, CHUNK_WORDS, PASSAGE_WORDS = 50_000, 500_000, 2_000
SLICE_BYTES = 1 << 20

def _sliding(x: np.ndarray, length: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest of each so many neighbours."""
    have, out = 1, x
    while 2 * have <= length:
        out, have = best(out[:-have], out[have:]), 2 * have
    return best(out[: len(x) - length + 1], out[length - have :]) if have < length else out


class Words:
    """Words of a few texts laid end to end, with hashes of words, and the anchor of each window."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, tile: int = TILE):
        self.window, self.tile = window, tile
        #: hashes, and the words before each text
        self.hashes, self.offsets = word_hashes(texts)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        n = len(self.hashes)
        if n >= window:
            self.tiles = np.maximum(phrases(self.hashes, tile, ODD[1]), np.uint64(1))
            self.whole = self.text_of[: n - window + 1] == self.text_of[window - 1 :]
            #: of each window; 0 for windows that reach into the next text
            self.anchors = np.where(self.whole, _sliding(self.tiles, window - tile + 1, np.minimum), np.uint64(0))
        else:
            self.anchors = np.zeros(0, np.uint64)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows that begin at these words."""
        return tuple(phrases(self.hashes, self.window, base)[at].view(np.int64) for base in ODD[1:])

    def anchors_of(self, i: int) -> np.ndarray:
        a, b = self.offsets[i], self.offsets[i + 1]
        return self.anchors[a : max(a, b - self.window + 1)]


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).fill_null(b"").to_pylist()


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "text", SLICE_BYTES)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            texts = _bytes(part.column("text"))
            words = Words(texts)
            anchors = [np.unique(words.anchors_of(i)).view(np.int64) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc"),
                    part.column("digest"),
                    pa.array(_marks(texts), pa.int64()),
                    pa.array(np.diff(words.offsets), pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]),
                    _lists(anchors, pa.int64()),
                ],
                ["doc", "digest", "mark", "n_words", "words_sha256", "anchors"],
            )


def _marks(texts: list[bytes]) -> list[int]:
    """31 bits that tell apart texts under one doc_id."""
    return [zlib.crc32(t) >> 1 for t in texts]


def _recurring_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of candidates whose anchor is shared."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            texts = _bytes(part.column("text"))
            words = Words(texts)
            wanted, docs, at = [], [], []
            for i, (doc, mark, anchors) in enumerate(zip(part.column("doc").to_pylist(), _marks(texts), part.column("anchors").to_pylist())):
                own = np.flatnonzero(np.isin(words.anchors_of(i), np.array(anchors, np.int64).view(np.uint64)))
                wanted.append(own + words.offsets[i])
                docs.append(np.full(len(own), doc, np.int64))
                at.append(own + (mark << 32))
            one, two = words.windows(np.concatenate(wanted)) if sum(map(len, wanted)) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, np.concatenate(docs), np.concatenate(at).astype(np.int64))], ["w1", "w2", "doc", "at"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of owned recurring windows of each owner, cut to PASSAGE_WORDS."""
    for batch in _parts(batches):
        owners, phrases, sizes, anchors = [], [], [], []
        for doc, text, at in zip(batch.column("doc").to_pylist(), _bytes(batch.column("text")), batch.column("at").to_pylist()):
            mark = _marks([text])[0]
            at = np.unique(np.array([a & 0xFFFFFFFF for a in at if a >> 32 == mark], np.int64))
            if not len(at):
                continue
            words, cut = Words([text]), text.split()
            breaks = np.flatnonzero(np.diff(at) > 1) + 1
            for run in np.split(at, breaks):
                for begin in range(int(run[0]), int(run[-1]) + 1, PASSAGE_WORDS - WINDOW + 1):
                    last = min(begin + PASSAGE_WORDS - WINDOW, int(run[-1]))  # the last window
                    owners.append(doc)
                    phrases.append(b" ".join(cut[begin : last + WINDOW]))
                    sizes.append(last + WINDOW - begin)
                    anchors.append(np.unique(words.anchors[begin : last + 1]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(owners, pa.int64()), pa.array(phrases, pa.binary()), pa.array(sizes, pa.int64()), _lists(anchors, pa.int64())],
            ["owner", "phrase", "size", "anchors"],
        )


class PhraseAutomaton:
    """Aho-Corasick automaton over words: finds which windows of a text its passages have.

    The automaton finds tiles; the windows around a tile are then looked up among the passages' windows, as
    they are. Each window of a text is looked up once, however often tiles repeat.
    """

    def __init__(self, passages: list[tuple[int, list[bytes]]]):
        self.ids: dict[bytes, int] = {}
        self.owner: dict[bytes, int] = {}
        self.owners = {owner for owner, _ in passages}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for owner, words in passages:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            for start in range(0, len(ids) - TILE + 1, TILE):
                self.automaton.add_word(tuple(ids[start : start + TILE]))
            held = np.array(ids, np.int32).tobytes()
            for start in range(0, 4 * (len(ids) - WINDOW + 1), 4):
                self.owner[held[start : start + 4 * WINDOW]] = owner
        if self.owner:
            self.automaton.make_automaton()

    def covered(self, doc: int, text: list[bytes]) -> np.ndarray:
        """Which words of the text lie in a window of a passage that another document owns."""
        n = len(text)
        edges = np.zeros(n + 1, np.int64)
        if n < WINDOW or not self.owner:
            return edges[:n] > 0
        ids = [self.ids.get(w, 0) for w in text]
        ends = np.array([end for end, _ in self.automaton.iter(tuple(ids))], np.int64)
        # a window of a passage has a tile that begins TILE words after its start at most
        near = np.zeros(n + 2, np.int64)
        np.add.at(near, np.maximum(ends + 1 - 2 * TILE, 0), 1)
        np.add.at(near, ends + 2 - TILE, -1)
        starts = np.flatnonzero(np.cumsum(near)[: n - WINDOW + 1])
        held, owner = np.array(ids, np.int32).tobytes(), self.owner
        found = np.array([(o := owner.get(held[4 * s : 4 * (s + WINDOW)])) is not None and o != doc for s in starts.tolist()], bool)
        found = starts[found] if len(starts) else starts
        np.add.at(edges, found, 1)
        np.add.at(edges, found + WINDOW, -1)
        return np.cumsum(edges)[:n] > 0


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate and shard the runs of windows with an anchor of the shard."""
    for batch in _parts(batches):
        rows = {"shard": [], "doc": [], "mark": [], "start": [], "size": [], "phrase": []}
        for doc, text, doors in zip(batch.column("doc").to_pylist(), _bytes(batch.column("text")), batch.column("doors")):
            words, cut, mark = Words([text]), text.split(), _marks([text])[0]
            shards = doors.values.field("shard").to_numpy()
            anchors = doors.values.field("anchor").to_numpy().view(np.uint64)
            for shard in np.unique(shards):
                starts = np.flatnonzero(np.isin(words.anchors, anchors[shards == shard]))
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > WINDOW) + 1):
                    if len(run):
                        first, last = int(run[0]), int(run[-1]) + WINDOW
                        for column, value in zip(rows, (shard, doc, mark, first, last - first, b" ".join(cut[first:last]))):
                            rows[column].append(value)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))


def _locate(segments: pa.Table, passages: pa.Table) -> pa.Table:
    """Spans of covered words of each segment of a task."""
    automaton = PhraseAutomaton([(o, p.split()) for o, p in zip(passages.column("owner").to_pylist(), passages.column("phrase").to_pylist())])
    owners, known = automaton.owners, {}
    rows = {"doc": [], "mark": [], "spans": []}
    for doc, mark, start, phrase in zip(*(segments.column(c).to_pylist() for c in ("doc", "mark", "start", "phrase"))):
        # segments that copy each other are looked up once; only for an owner the answer is its own
        edges = known.get(phrase) if doc not in owners else None
        if edges is None:
            cover = automaton.covered(doc, phrase.split())
            edges = np.flatnonzero(np.diff(np.concatenate(([0], cover.view(np.int8), [0])))).reshape(-1, 2).tolist()
            if doc not in owners:
                known[phrase] = edges
        if edges:
            rows["doc"].append(doc)
            rows["mark"].append(mark)
            rows["spans"].append([{"start": start + a, "end": start + b} for a, b in edges])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return pa.table(rows, pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("spans", pa.list_(span))]))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each candidate with spans."""
    for batch in _parts(batches):
        texts = _bytes(batch.column("text"))
        removed, kept = [], []
        for text, spans in zip(texts, batch.column("spans").to_pylist()):
            words = text.split()
            cover = np.zeros(len(words), bool)
            for shard in spans:
                for span in shard:
                    cover[span["start"] : span["end"]] = True
            removed.append(int(cover.sum()))
            kept.append(b" ".join([w for w, c in zip(words, cover.tolist()) if not c]))
        columns = [batch.column("doc"), batch.column("mark"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "mark", "n_removed", "kept_text"])


def passage_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, n_words, n_removed, words_sha256, kept_text for every row of docs.

    Words are runs of bytes that aren't ASCII blanks. Each word in a window whose words also start in a
    document of smaller doc_id is removed; windows are those of the input. kept_text joins the words
    left by one blank; it is null where nothing is removed, and words_sha256 is the digest of all words
    joined so. Null texts and texts of fewer than WINDOW words lose nothing. Rows that repeat an
    id never remove from each other; rows of null id come after all others. Texts of any length are taken whole. An empty
    table gives no rows; other columns are not read, whatever their names.
    """
    rows = docs.select(F.coalesce(named(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc"), named(text).alias("text"))
    digested = rows.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    sketch = materialize(
        digested.mapInArrow(_sketch, "doc bigint, digest binary, mark bigint, n_words bigint, words_sha256 string, anchors array<bigint>"), "sketch"
    )
    # Tables that a join meets on a key which many rows share are written, so that Spark may split or broadcast it.
    first = materialize(sketch.groupBy("digest").agg(F.min("doc").alias("first")), "first")

    # Anchors that different texts share, of the first copy of each text.
    anchors = sketch.select("doc", F.xxhash64("digest").alias("content"), F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("content").alias("a"), F.max("content").alias("b")).filter("a < b").select("anchor")
    shared = materialize(shared, "shared_anchors")
    hits = anchors.join(shared, "anchor").groupBy("doc", "content").agg(F.collect_set("anchor").alias("anchors"))
    originals = first.select(F.xxhash64("digest").alias("content"), F.col("first").alias("doc"))
    hits = hits.join(originals, ["doc", "content"]).groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("anchors"))
    candidates = materialize(rows.join(hits, "doc"), "candidates")
    release(docs.sparkSession)

    windows = candidates.mapInArrow(_recurring_windows, "w1 bigint, w2 bigint, doc bigint, at bigint")
    owned = windows.groupBy("w1", "w2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.min_by("at", "doc").alias("at"))
    owned = owned.filter("owner < last").groupBy(F.col("owner").alias("doc")).agg(F.collect_list("at").alias("at"))
    passages = candidates.join(owned, "doc").select("doc", "text", "at").mapInArrow(_passages, "owner bigint, phrase binary, size bigint, anchors array<bigint>")
    passages = materialize(passages, "passages")
    release(docs.sparkSession)

    total = passages.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    # passages are dealt one by one, however many an owner has
    sharded = passages.withColumn("shard", F.pmod(F.xxhash64("owner", "phrase"), F.lit(shards)).cast("int"))
    doors = materialize(sharded.select("shard", F.explode("anchors").alias("anchor")).distinct(), "doors")
    routes = candidates.select("doc", F.explode("anchors").alias("anchor")).join(doors, "anchor")
    routes = routes.groupBy("doc").agg(F.collect_set(F.struct("anchor", "shard")).alias("doors"))
    routed = candidates.select("doc", "text").join(routes, "doc")
    segments = materialize(
        routed.mapInArrow(_segments, "shard int, doc bigint, mark bigint, start int, size bigint, phrase binary"), "segments"
    )
    release(docs.sparkSession)
    # One row a shard: enough tasks for what is streamed through it, however common its passages are.
    loads = materialize(segments.groupBy("shard").agg(F.ceil(F.sum("size") / CHUNK_WORDS).cast("int").alias("chunks")), "loads")
    split = segments.join(loads, "shard").withColumn("chunk", F.pmod(F.xxhash64("doc", "start"), "chunks").cast("int"))
    copied = sharded.join(loads, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spans = (
        split.select("shard", "chunk", "doc", "mark", "start", "phrase")
        .groupBy("shard", "chunk")
        .cogroup(copied.select("shard", "chunk", "owner", "phrase").groupBy("shard", "chunk"))
        .applyInArrow(_locate, "doc bigint, mark bigint, spans array<struct<start:int,end:int>>")
    )
    spans = spans.groupBy("doc", "mark").agg(F.collect_list("spans").alias("spans"))
    marked = candidates.select("doc", "text", F.shiftright(F.crc32(F.col("text").cast("binary")), 1).alias("mark"))
    changed = marked.join(spans, ["doc", "mark"]).mapInArrow(_remove, "doc bigint, mark bigint, n_removed bigint, kept_text string")
    changed = materialize(changed.dropDuplicates(["doc", "mark"]), "changed")

    copied_whole = (F.col("doc") > F.col("first")) & (F.col("n_words") >= WINDOW)
    return (
        sketch.drop("anchors")
        .join(changed, ["doc", "mark"], "left")
        .join(first, "digest")
        .select(
            F.nullif("doc", F.lit(NO_ID)).alias("doc_id"),
            "n_words",
            F.when(copied_whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
            "words_sha256",
            F.when(copied_whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        )
    )
