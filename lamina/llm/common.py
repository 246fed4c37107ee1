"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import materialize  # noqa: F401  the operators take it from here

#: Stands for a null id inside joins; null ids sort after every other id.
NO_ID = 2**63 - 1

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same for str.translate.
LOWER = str.maketrans(UPPER, UPPER.lower())


#: What Python workers keep from task to task.
_lasting: list = []


def lasting(make: Callable) -> Callable:
    """make with its last result kept, which tasks of an operator share in a worker until those of another begin."""
    cached = lru_cache(maxsize=1)(make)
    _lasting.append(cached)
    return cached


def give_back() -> None:
    """Give memory that allocators hold free back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


@contextmanager
def worker(*own: Callable) -> Iterator[None]:
    """Around the work of a task: what only tasks of other operators use is let go first, and free memory is given back at the end.

    Workers outlive stages; what one stage leaves would be held beside the memory of the next.
    """
    for cached in _lasting:
        if cached not in own:
            cached.cache_clear()
    try:
        yield
    finally:
        give_back()


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def named(column: str) -> Column:
    """The column of this very name, whatever characters the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_first(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of docs but those that another of their group comes before.

    rows: doc (the id), mark (xxhash64 of the text), node and group of the rows of docs that may go. Of a group the row of
    least doc, node and mark stays, and of those that repeat its id and text one.
    """
    rows = materialize(rows, "grouped")
    first = materialize(rows.groupBy("group").agg(F.min(F.struct("doc", "node", "mark")).alias("x")).select("group", "x.doc", "x.mark"), "first")
    first = first.select("group", F.col("doc").alias("of_doc"), F.col("mark").alias("of_mark"))
    gone = rows.join(first, "group").filter("doc <> of_doc or mark <> of_mark").select("doc", "mark").distinct()
    again = rows.groupBy("doc", "mark").count().filter("count > 1").select("doc", "mark")
    gone, again = materialize(gone, "gone"), materialize(again, "again")
    doc, mark = unused(docs, "kept_id"), unused(docs, "kept_mark")
    marked = docs.withColumn(doc, named(doc_id).cast("bigint")).withColumn(mark, F.xxhash64(named(text)))

    def on(other: DataFrame) -> DataFrame:
        return other.select(F.col("doc").alias(doc), F.col("mark").alias(mark))

    kept = marked.join(on(gone), [doc, mark], "left_anti")
    if again.limit(1).count():
        kept = kept.join(on(again), [doc, mark], "left_anti").unionByName(kept.join(on(again), [doc, mark], "left_semi").dropDuplicates([doc, mark]))
    return kept.select(*map(named, docs.columns))


def portions(items: list, weights: list[int], most: int) -> Iterator[list]:
    """Cut items so that the weights of a cut add up to most, or it is one item."""
    some, total = [], 0
    for item, weight in zip(items, weights):
        if some and total + weight > most:
            yield some
            some, total = [], 0
        some.append(item)
        total += weight
    if some:
        yield some


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the strings of a cut are about max_bytes; one row at least."""
    col = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
