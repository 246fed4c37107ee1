"""Exact k-nearest-neighbour table of sparse vectors that hold no negative value, by inner product.

Equal vectors are one node. Nodes of like places and sizes are put into parts of bounded size, and every two parts meet
once in a task, which serves the rows of both. There the places that many rows of both parts hold are multiplied as
dense matrices in single precision, the others by their lists of rows. Rounding errors are bounded, whatever they
can't rule out is scored exactly: products are added in the order of the places, as if vectors were dense.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import materialize

from . import blocks

#: Rows, and entries, of a part and of a chunk, in which parts are stored; least number of parts where there are rows for them.
PART_ROWS, PART_PLACES, CHUNK_ROWS, CHUNK_PLACES, PARTS = 20_480, 5_242_880, 2_048, 524_288, 12
#: Below so many rows one part is enough.
ONE_PART = 2_048
#: Queries that are compared with a part at once, and rows whose best stands for all; products of lists, and queries, at once.
ASKED, TOGETHER, PRODUCTS, ROWS_AT_ONCE = 256, 32, 1 << 16, 4
#: A place is multiplied densely if products that are not zero are a larger share of its pairs than this.
DENSE = 0.0018
#: Rows, and entries of a row, of the sample that likeness is learnt from (it decides only which task rows go to), kinds told apart, and rounds.
SAMPLE_ROWS, SAMPLE_PLACES, KINDS, STEPS = 4_096, 2_048, 8, 8
#: Values are 0 or at least so large, and at most its inverse, so that products keep their accuracy in single precision.
LEAST = 1e-15
#: Numbers of a dense matrix at most.
MATRIX = 20_000_000
PACKED = "id bigint, digest binary, n int, gaps binary, codes binary, levels binary"


def _kind(width: int) -> type:
    """Of places below width, and of the numbers of a row's values."""
    return np.uint16 if width <= 65_536 else np.uint32


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value for each run of so many values."""
    ends = np.concatenate(([0], np.cumsum(sizes))) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _flat(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    parts = [x.cast(pa.large_binary()) for x in table.column(column).chunks]
    flat, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for x in parts:
        if not len(x):
            continue
        ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
        if ends[-1] > ends[0]:
            flat.append(np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
        sizes.append(np.diff(ends) // np.dtype(kind).itemsize)
    return np.concatenate(flat), np.concatenate(sizes)


def pack(table: pa.Table, width: int) -> pa.Table:
    """id, digest, n, gaps, codes, levels: a row holds each of its values once (levels), and of each entry the gap
    to the place before and the number of its value."""
    lists = table.column("places").combine_chunks(), table.column("values").combine_chunks()
    places, values = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    sizes = np.diff(lists[0].offsets.to_numpy())
    if len(values) and not ((values == 0) | (values >= LEAST) & (values <= 1 / LEAST)).all():
        raise ValueError(f"values must be 0 or from {LEAST} to {1 / LEAST}")
    if len(places) and not (places.min() >= 0 and places.max() < width):
        raise ValueError(f"places must be from 0 to {width - 1}")
    of = np.repeat(np.arange(len(sizes)), sizes)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    gaps = np.diff(places, prepend=0)
    gaps[first] = places[first]
    order = np.lexsort((values, of))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(values[order]) != 0) | (np.diff(of[order]) != 0)
    held = np.bincount(of[order][new], minlength=len(sizes))
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(new) - 1
    codes -= np.repeat(np.cumsum(held) - held, sizes)
    kind = _kind(width)
    packed = _binary(gaps.astype(kind), sizes), _binary(codes.astype(kind), sizes), _binary(values[order][new], held)
    digests = [hashlib.blake2b(b"".join(row), digest_size=16).digest() for row in zip(*(x.to_pylist() for x in packed))]
    return pa.table([table.column("id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), *packed], names=["id", "digest", "n", "gaps", "codes", "levels"])


class Bags:
    """Vectors of packed tables: of all rows the ascending places and the values, where rows end, and their ids.

    known: a score that as many rows as are sought reach.
    """

    def __init__(self, tables: Iterable[pa.Table], width: int):
        ids, known, sizes, places, values = [], [], [], [], []
        for table in tables:  # one after the other, as what lies between takes much more memory
            ids.append(table.column("id").to_numpy())
            known.append(table.column("known").to_numpy() if "known" in table.column_names else np.zeros(len(table)))
            gaps, size = _flat(table, "gaps", _kind(width))
            ends = np.concatenate(([0], np.cumsum(size)))
            total = np.cumsum(gaps, dtype=np.int64)
            total -= np.repeat(np.concatenate(([0], total))[ends[:-1]], size)
            sizes.append(size)
            places.append(total.astype(np.int32))
            codes, _ = _flat(table, "codes", _kind(width))
            levels, held = _flat(table, "levels", np.float64)
            values.append(levels[np.repeat(np.cumsum(held) - held, size) + codes])
        self.ids, self.known, self.sizes, self.places = (np.concatenate(x) for x in (ids, known, sizes, places))
        del places
        self.values = np.concatenate(values)
        self.ends = np.concatenate(([0], np.cumsum(self.sizes)))

    @classmethod
    def of(cls, chunks: list[bytes], width: int) -> Bags:
        bags = cls((pa.ipc.open_stream(x).read_all() for x in chunks), width)
        _trim()
        return bags

    def of_rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.sizes)


def _pairs(bags: Bags, asked: Bags, q: np.ndarray, r: np.ndarray, width: int) -> np.ndarray:
    """Inner products of rows q of asked (ascending) and rows r of bags, added in the order of the places."""
    out = np.zeros(len(q))
    line = np.zeros(width)
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(q)]):
        own = slice(asked.ends[q[first]], asked.ends[q[first] + 1])
        line[asked.places[own]] = asked.values[own]
        for at in range(first, last, 1_024):
            some = r[at : min(last, at + 1_024)]
            theirs = bags.sizes[some]
            places = np.concatenate([bags.places[a:b] for a, b in zip(bags.ends[some].tolist(), bags.ends[some + 1].tolist())])
            values = np.concatenate([bags.values[a:b] for a, b in zip(bags.ends[some].tolist(), bags.ends[some + 1].tolist())])
            out[at : at + len(some)] = np.bincount(np.repeat(np.arange(len(some)), theirs), weights=line[places] * values, minlength=len(some))
        line[asked.places[own]] = 0
    return out


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every row, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows) < k]


def _least(top: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What a rough score must reach if top is reached k times. All terms are positive, so errors are a share of the sum."""
    slack = 2.1 * 2.0**-24 * (sizes + 16)
    return np.maximum(top * (1 - slack), 1e-37).astype(np.float32)


def meet(left: Bags, right: Bags | None, k: int, width: int):
    """Ids, ids of others and scores: the k best positive products that each row of either part has in the other one.

    Without a right part the rows of the left one meet each other, and themselves.
    """
    both, right = right is not None, right if right is not None else left
    held = [np.bincount(x.places, minlength=width) for x in (left, right)]
    n = len(right.ids)
    wide = -(-n // TOGETHER) * TOGETHER
    share = held[0] * (held[1] / (len(left.ids) * len(right.ids)))
    head = np.argsort(-share, kind="stable")[: MATRIX // wide]
    head = np.sort(head[share[head] > DENSE])
    column = np.full(width, -1, np.int32)
    column[head] = np.arange(len(head))
    dense = np.zeros((len(head), wide), np.float32)
    rest, lines = [], []
    for start in range(0, n, CHUNK_ROWS):
        stop = min(n, start + CHUNK_ROWS)
        some = slice(right.ends[start], right.ends[stop])
        places, values = right.places[some], right.values[some].astype(np.float32)
        of, at = np.repeat(np.arange(start, stop), right.sizes[start:stop]), column[places]
        dense[at[at >= 0], of[at >= 0]] = values[at >= 0]
        # Row and value of an entry in one number: the value is the lower half.
        lines.append(of[at < 0] << 32 | values[at < 0].view(np.uint32))
        rest.append(places[at < 0].astype(_kind(width)))
    entries = np.concatenate(lines)
    del lines
    entries = entries[np.argsort(np.concatenate(rest), kind="stable")]
    del rest
    ends = np.concatenate(([0], np.cumsum(np.where(column < 0, held[1], 0))))
    lists = np.diff(ends)
    best = np.repeat(right.known[None], k, axis=0).astype(np.float32)  # of each right row: scores that k rows reach
    found, offered = [], []
    for start in range(0, len(left.ids), ASKED):
        stop = min(len(left.ids), start + ASKED)
        low, high = left.ends[start], left.ends[stop]
        places, values = left.places[low:high], left.values[low:high]
        of, at = np.repeat(np.arange(stop - start), left.sizes[start:stop]), column[places]
        asked = np.zeros((stop - start, len(head)), np.float32)
        asked[of[at >= 0], at[at >= 0]] = values[at >= 0]
        rough = asked @ dense
        some = (at < 0) & (lists[places] > 0)
        places, values, of = places[some], values[some], of[some]
        sizes, first = lists[places], ends[places]
        edges = np.searchsorted(of, np.arange(stop - start + 1))
        made = np.concatenate(([0], np.cumsum(sizes)))[edges]
        i = 0
        while i < stop - start:
            j = max(i + 1, min(i + ROWS_AT_ONCE, int(np.searchsorted(made, made[i] + PRODUCTS, side="right")) - 1))
            own, total = slice(edges[i], edges[j]), int(made[j] - made[i])
            if total:
                runs = sizes[own]
                at = np.repeat(first[own] - (np.cumsum(runs) - runs), runs)
                at += np.arange(total)
                some = entries[at]
                products = some.view(np.float32)[::2] * np.repeat(values[own].astype(np.float32), runs)
                some >>= 32
                some += np.repeat((of[own] - i) * wide, runs)
                rough[i:j] += np.bincount(some, weights=products, minlength=(j - i) * wide).reshape(j - i, wide)
            i = j
        groups = wide if wide <= 1_024 else 1_024
        tops = rough[:, : wide // groups * groups].reshape(stop - start, -1, groups).max(axis=1)
        top = np.partition(tops, groups - k, axis=1)[:, groups - k] if groups > k else np.zeros(stop - start, np.float32)
        wanted = _least(np.maximum(top, left.known[start:stop]), left.sizes[start:stop])
        mask = rough >= wanted[:, None]
        if both:
            offers = [rough[i : i + TOGETHER, :n].max(axis=0) for i in range(0, stop - start, TOGETHER)]
            best = np.partition(np.concatenate([best, np.stack(offers)]), len(offers), axis=0)[len(offers) :]
            limit = np.full(wide, np.inf, np.float32)
            limit[:n] = _least(best[0], right.sizes)
            mask |= rough >= limit
        q, r = np.divmod(np.flatnonzero(mask), wide)
        score = rough[q, r]
        mine = score >= wanted[q]
        found.append((q[mine] + start, r[mine]))
        if both:
            theirs = score >= limit[r]
            offered.append((q[theirs] + start, r[theirs], score[theirs]))
    if both:
        q, r, score = (np.concatenate(x) for x in zip(*offered))
        last = score >= _least(best[0], right.sizes)[r]
        found.append((q[last], r[last]))
    q, r = (np.concatenate(x) for x in zip(*found))
    q, r = np.divmod(np.unique(q * n + r), n)
    score = _pairs(right, left, q, r, width)
    q, r, score = q[score > 0], r[score > 0], score[score > 0]
    some = _best(q, right.ids[r], score, k)
    out = left.ids[q[some]], right.ids[r[some]], score[some]
    if both:
        some = _best(r, left.ids[q], score, k)
        out = tuple(np.concatenate(x) for x in zip(out, (right.ids[r[some]], left.ids[q[some]], score[some])))
    return out


def _learn(bags: Bags, width: int) -> np.ndarray:
    """Mean directions of kinds of rows, one a column."""
    of, n = bags.of_rows(), len(bags.ids)
    label = np.arange(n) % KINDS  # of the first rows, each is a kind
    label[KINDS:] = -1
    for _ in range(STEPS):
        known = label[of] >= 0
        centres = np.bincount(bags.places[known] * KINDS + label[of[known]], weights=bags.values[known], minlength=width * KINDS).reshape(width, KINDS)
        centres /= np.maximum(np.sqrt((centres * centres).sum(axis=0)), 1e-300)
        label = _like(bags, centres)
    return centres


def _like(bags: Bags, centres: np.ndarray) -> np.ndarray:
    """The kind that each row is most alike."""
    of = bags.of_rows()
    return np.stack([np.bincount(of, weights=bags.values * c[bags.places], minlength=len(bags.ids)) for c in np.ascontiguousarray(centres.T)]).argmax(axis=0)


def _parts(nodes: DataFrame) -> tuple[DataFrame, int]:
    """nodes with part and chunk. Kinds, and sizes within a kind, follow each other; rows of a group are dealt by a hash."""
    group = ["kind", "class"]
    sizes = sorted(map(tuple, nodes.groupBy(group).agg(F.count("*"), F.sum("n")).collect()))  # at most KINDS times 60
    rows, entries = sum(x[2] for x in sizes), sum(x[3] for x in sizes)
    parts = max(-(-rows // PART_ROWS), -(-entries // PART_PLACES), min(PARTS, -(-rows // ONE_PART)), 1)
    chunks = max(-(-rows // (parts * CHUNK_ROWS)), -(-entries // (parts * CHUNK_PLACES)), 1)
    at, edges = 0.0, []
    for kind, size, n, held in sizes:
        weight = (n / rows + held / entries) / 2
        edges.append((kind, size, at, weight))
        at += weight
    edges = nodes.sparkSession.createDataFrame(edges or [(0, 0, 0.0, 0.0)], "kind int, class int, at double, weight double")
    dealt = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    part = F.least(F.floor((F.col("at") + dealt * F.col("weight")) * parts), F.lit(parts - 1)).cast("int")
    return nodes.join(F.broadcast(edges), group).withColumn("part", part).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(chunks)).cast("int")), parts


def _nodes(packed: DataFrame, width: int) -> DataFrame:
    """One row for each vector that has entries: the smallest id, with kind and class, the binary logarithm of twice the entries squared."""
    held = packed.filter("n > 0")
    sample = held.filter(F.col("n") <= SAMPLE_PLACES).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE_ROWS).toArrow()
    centres = _learn(Bags([sample], width), width) if len(sample) else np.ones((width, KINDS))

    def kinds(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kind = _like(Bags([table], width), centres) if len(table) else np.zeros(0, np.int64)
            yield table.append_column("kind", pa.array(kind, pa.int32())).to_batches()[0] if len(table) else None

    def some(batches):
        return (x for x in kinds(batches) if x is not None)

    first = [F.first(c).alias(c) for c in ("n", "gaps", "codes", "levels")]  # equal in all rows
    rows = held.groupBy("digest").agg(F.min("id").alias("id"), *first).select("id", "digest", "n", "gaps", "codes", "levels")
    return materialize(rows.mapInArrow(some, f"{PACKED}, kind int").withColumn("class", F.floor(2 * F.log2("n")).cast("int")), "nodes")


def _trim() -> None:
    """Give free memory back: workers keep what other tasks had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def _write(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _found(found) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in found], names=["query", "other", "score"])


def _inside(chunks: DataFrame, parts: int, k: int, width: int) -> DataFrame:
    """query, other, score of nodes whose parts meet themselves; part and held: the chunks with the scores known by then."""

    def task(batches):
        held: dict = {}
        for batch in batches:
            for part, chunk in zip(*(batch.column(i).to_pylist() for i in range(2))):
                held.setdefault(part, []).append(chunk)
        for part, chunks in held.items():
            _trim()
            bags = Bags.of(chunks, width)
            found = _found(meet(bags, None, k, width))
            empty = [pa.nulls(len(found), t) for t in (pa.int32(), pa.binary())]
            yield pa.record_batch([*found.columns, *empty], names=[*found.schema.names, "part", "held"])
            query, score = found.column(0).to_numpy(), found.column(2).to_numpy()
            order = np.lexsort((-score, query))
            query, score = query[order], score[order]
            for chunk in chunks:
                table = pa.ipc.open_stream(chunk).read_all()
                ids = table.column("id").to_numpy()
                low, high = (np.searchsorted(query, ids, side=x) for x in ("left", "right"))
                known = np.where(high - low >= k, score[np.minimum(low + k - 1, len(score) - 1)], 0.0)
                table = _write(table.append_column("known", pa.array(known)))
                yield pa.record_batch([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.float64())), pa.array([part], pa.int32()), pa.array([table], pa.binary())], names=["query", "other", "score", "part", "held"])

    dealt = chunks.select("part", "held").repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(task, "query bigint, other bigint, score double, part int, held binary")


def _between(chunks: DataFrame, parts: int, k: int, width: int) -> DataFrame:
    """query, other, score of nodes: every two parts meet in a task of their own."""
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda x: x != F.col("part")))
    sides = chunks.withColumn("other", other).withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other"))
    cell = (F.col("b") * (F.col("b") - 1) / 2 + F.col("a")).cast("int")
    dealt = sides.select("a", "b", "part", "held").repartitionById(parts * (parts - 1) // 2, cell)

    def task(batches):
        cells: dict = {}
        for batch in batches:
            for a, b, part, held in zip(*(batch.column(i).to_pylist() for i in range(4))):
                cells.setdefault((a, b), {}).setdefault(part, []).append(held)
        while cells:
            (a, b), held = cells.popitem()
            _trim()
            if len(held) == 2:
                yield _found(meet(Bags.of(held.pop(a), width), Bags.of(held.pop(b), width), k, width))

    return dealt.mapInArrow(task, "query bigint, other bigint, score double")


def knn_sparse(rows: DataFrame, k: int, width: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows of greatest inner product, without the row itself.

    rows: id (of one row each), places (ascending, below width) and values, which are 0 or from LEAST to its inverse.
    Rows without a place take part with product 0. Ties go to the smaller id.
    """

    def packing(batches):
        for batch in batches:
            yield from pack(pa.Table.from_batches([batch]), width).to_batches()

    def chunk(table: pa.Table) -> pa.Table:
        held = _write(table.select(["id", "gaps", "codes", "levels"]).combine_chunks())
        return pa.table({"part": table.column("part")[:1], "held": pa.array([held], pa.binary())})

    packed = materialize(rows.select("id", "places", "values").mapInArrow(packing, PACKED), "packed")
    dealt, parts = _parts(_nodes(packed, width))
    chunks = materialize(dealt.groupBy("part", "chunk").applyInArrow(chunk, "part int, held binary"), "chunks")
    # A row more than k of every list, as a row's own node and the row itself are among them.
    inside = materialize(_inside(chunks, parts, k + 1, width), "inside")
    found = inside.filter("query is not null").select("query", "other", "score")
    if parts > 1:
        found = found.unionByName(_between(inside.filter("held is not null").select("part", "held"), parts, k + 1, width))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "other")
    found = found.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    members = packed.select("id", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    equal = members.filter("digest is not null")
    heads = equal.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).filter(F.col("r") <= k + 1)
    heads = materialize(heads.withColumn("node", F.min("id").over(Window.partitionBy("digest"))).select("id", "digest", "node"), "heads")
    near = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.join(heads.select(F.col("node").alias("other"), "id"), "other").withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    best = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
    names = heads.filter("id = node").select("digest", F.col("node").alias("query"))
    best = materialize(best.join(names, "query").select("digest", "near"), "best")
    few = [x[0] for x in packed.select("id").orderBy("id").limit(2 * k + 1).collect()]
    rest = F.array([F.struct(F.lit(x).cast("bigint").alias("id"), F.lit(0.0).alias("score")) for x in few]) if few else F.array().cast("array<struct<id:bigint,score:double>>")
    near = F.transform(F.col("near"), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    empty = members.filter("digest is null").select("id", F.array().cast("array<struct<id:bigint,score:double>>").alias("near"))
    all_rows = equal.join(best, "digest").select("id", near.alias("near")).unionByName(empty)
    fill = F.filter(rest, lambda x: ~F.exists("near", lambda y: y["id"] == x["id"]))
    lists = F.slice(F.filter(F.concat("near", fill), lambda x: x["id"] != F.col("id")), 1, k)
    out = all_rows.select(F.col("id").alias("query_id"), F.posexplode(lists).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
