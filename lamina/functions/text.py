"""Column functions that turn texts into hashed bags of words."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V

BUCKETS = 16_384

#: The words that are never counted.
STOP_WORDS = (
    "a an and are as at be been but by can did do for from had has have he her him his if in into is it its "
    "may more most not of on or our out she so such than that the their them then there these they this to up "
    "was we were what when which who will with would you your"
).split()


_SPACE = r"\s\x0b\x{85}\x{a0}\p{Z}"


def normalize_body(text: Column) -> Column:
    """Without carriage returns; runs of white space become one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), f"[{_SPACE}]+", " "))


def _before_last(text: Column, mark: str) -> Column:
    """Text before the last occurrence of mark; all of it if there is none."""
    found = F.instr(F.reverse(text), mark[::-1])
    return F.when(found > 0, F.left(text, F.length(text) - found - (len(mark) - 1))).otherwise(text)


def strip_message(text: Column) -> Column:
    """A news message without header (up to the first blank line) and signature, with white space normalised."""
    text = F.replace(text, F.lit("\r"), F.lit(""))
    head = F.instr(text, "\n\n")
    body = F.when(head > 0, F.substring(text, head + 2, F.length(text))).otherwise(text)
    return normalize_body(_before_last(_before_last(body, "\n-- \n"), "\n--\n"))


def normalize_token(word: Column) -> Column:
    """ASCII letters and digits of a word, in lower case; null if fewer than three are left or it is a stop word."""
    kept = F.lower(F.regexp_replace(word, "[^A-Za-z0-9]", ""))
    return F.when((F.length(kept) >= 3) & ~kept.isin(*STOP_WORDS), kept)


def tokens(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and token for every counted token of every text.

    Texts are cleaned whole and cut then, which gives the words that normalize_token makes of each word of the body.
    """
    cleaned = F.lower(F.regexp_replace(F.replace(F.col(text), F.lit("\r"), F.lit("")), f"[^A-Za-z0-9{_SPACE}]+", ""))
    words = df.select(doc_id, F.explode(F.split(cleaned, f"[{_SPACE}]+")).alias("token"))
    return words.filter((F.length("token") >= 3) & ~F.col("token").isin(*STOP_WORDS))


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % buckets


def hashed_bag(df: DataFrame, doc_id: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, bucket, weight: ln(1 + count) for every bucket that a text has tokens in."""
    placed = tokens(df, doc_id, text).select(doc_id, bucket(F.col("token"), buckets).alias("bucket"))
    return placed.groupBy(doc_id, "bucket").agg(F.log1p(F.count("*").cast("double")).alias("weight"))


def bag_norms(bag: DataFrame, doc_id: str) -> DataFrame:
    return bag.groupBy(doc_id).agg(F.greatest(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), F.lit(1e-12)).alias("norm"))


#: White space beyond ASCII, as in _SPACE; bytes of a text that are kept, in lower case; texts, and words remembered, at once.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LOWER = bytes(range(256)).lower()
_DROPPED = bytes(x for x in range(256) if not chr(x).isalnum() and x not in b" \t\n\x0b\x0c" or x > 127)
TEXTS, WORDS = 256, 200_000


class _Places(dict):
    """Bucket of every word seen; -1 for words that are never counted."""

    def __init__(self, buckets: int):
        self.buckets, self.never = buckets, {x.encode() for x in STOP_WORDS}

    def __missing__(self, word: bytes) -> int:
        place = -1 if len(word) < 3 or word in self.never else int(hashlib.md5(word).hexdigest()[:8], 16) % self.buckets
        self[word] = place
        return place


def _bags(ids: pa.Array, texts: pa.Array, known: _Places) -> pa.RecordBatch:
    places, sizes = [], []
    for text in texts.to_pylist():
        text = text or ""
        words = (text if text.isascii() else _WIDE.sub(" ", text)).encode().translate(_LOWER, _DROPPED).split()
        places.extend(map(known.__getitem__, words))
        sizes.append(len(words))
    held, rows = np.array(places, np.int64), np.repeat(np.arange(len(sizes)), sizes)
    keys, counts = np.unique((rows * known.buckets + held)[held >= 0], return_counts=True)
    rows, held = np.divmod(keys, known.buckets)
    each, which = np.unique(counts, return_inverse=True)
    weights = np.array([math.log(1 + n) for n in each.tolist()])[which]  # numpy's own differs in the last place
    norms = np.maximum(np.sqrt(np.bincount(rows, weights=weights * weights, minlength=len(sizes))), 1e-12)  # sums in order
    ends = pa.array(np.searchsorted(rows, np.arange(len(sizes) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (held, weights / norms[rows])]
    return pa.record_batch([ids, *lists], names=["id", "places", "values"])


def unit_bags(df: DataFrame, doc_id: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """id, places, values: for every row with an id its hashed bag over the bag's norm, by ascending bucket.

    The same as of hashed_bag, for texts that have an id of their own. Logarithms are those of the C library, as in SQL.
    """

    def task(batches):
        known = _Places(buckets)
        for batch in batches:
            for start in range(0, len(batch), TEXTS):
                if len(known) > WORDS:
                    known.clear()
                some = batch.slice(start, TEXTS)
                yield _bags(some.column(0), some.column(1), known)

    rows = df.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(task, "id bigint, places array<bigint>, values array<double>")


def merged_unit_bags(df: DataFrame, doc_id: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """The same for ids that several texts share, whose words count together."""
    held = hashed_bag(df, doc_id, text, buckets).groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    every = df.select(doc_id).distinct().join(held, doc_id, "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<bucket:bigint,weight:double>>")))
    return every.select(F.col(doc_id).alias("id"), F.col("m.bucket").alias("places"), V.l2_normalize_floor(F.col("m.weight")).alias("values"))
