"""Column functions over vectors (arrays of numbers).

Sums run from the first component to the last in double precision, so they can be compared bit by bit with
a SQL engine that does the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for the raw cosine distance of vectors with no positive similarity: the smallest positive normal float.
NO_SIMILARITY = 1.1754943508222875e-38
UNIT_TOLERANCE = 1e-5


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v over its norm; a zero vector is unchanged."""
    length = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


def l2_normalize_floor(v: Column, floor: float = 1e-12) -> Column:
    """v over the greater of its norm and floor."""
    length = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine_raw(a: Column, b: Column) -> Column:
    """Negated inner product of unit vectors if that is positive; else NO_SIMILARITY."""
    similarity = dot(a, b)
    return F.when(similarity > 0, -similarity).otherwise(F.lit(NO_SIMILARITY))


def int8_raw(a: Column, b: Column) -> Column:
    """Negated integer inner product."""
    products = F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long"))
    return -F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x)


def _bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))


def jaccard_raw(a: Column, b: Column) -> Column:
    """Negated share of common bits among bits of either packed vector; 0 if neither has one."""
    both = _bits(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    either = _bits(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(either == 0, 0.0).otherwise(-both.cast("double") / either)


def cosine_distance(raw: Column) -> Column:
    """0 from raw 0 on; else -log2 of the similarity, at least 0."""
    return F.when(raw >= 0, 0.0).otherwise(F.greatest(-F.log2(-raw), F.lit(0.0)))


def int8_distance(raw: Column) -> Column:
    return F.when(raw >= 0, 0.0).otherwise(F.lit(1.0) / -raw)


def jaccard_distance(raw: Column) -> Column:
    return F.when(raw >= 0, 0.0).otherwise(-F.log2(-raw))


def squared_euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def quantize_int8(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * 127 + 0.5).cast("int"))


def pack_signs(v: Column, width: int) -> Column:
    """Signs of the components (1 where positive) as words of 32 bits, each in a long."""
    words = []
    for start in range(0, width, 32):
        bits = [F.when(F.get(v, i) > 0, F.lit(1 << (i - start)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(start, min(start + 32, width))]
        word = bits[0]
        for bit in bits[1:]:
            word = word + bit
        words.append(word)
    return F.array(*words)


def pixels(image: Column) -> Column:
    """Bytes of a binary column as numbers from 0 to 255."""
    return F.transform(F.sequence(F.lit(1), F.length(image)), lambda i: F.conv(F.hex(F.substring(image, i, F.lit(1))), 16, 10).cast("float"))
